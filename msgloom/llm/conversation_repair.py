"""Repair of conversation structure at least cost, by depth-first branch and bound.

A conversation's role initials must spell ``(s?(ua)+)?``. Each row is kept, given the role that is due, or deleted, and rows
are inserted; :func:`repairs` finds the cheapest edits, and of equally cheap ones those whose initials (the audit) come first
in ASCII. A node of the search is (rows done, last role). An explicit stack is searched depth first, cheapest child on top;
a branch ends where its cost and a lower bound of what the other rows cost reach the incumbent's, or where the node's
dominance table holds a prefix that costs no more. An empty stack proves the incumbent's cost least. A second search within
that cost takes children in ASCII order. It meets a node's prefixes in ASCII order, so its table, too, only compares costs
(an audit-first table would search everything below a node anew for each of its equally dear prefixes), and its first end
proves the audit. Of two equally dear prefixes of one node none is the start of the other, as only inserting consumes no
row, so the smaller stays smaller whatever follows.

Rows are numbered by ranges of (conversation, turn), so a conversation that holds most rows is many tasks' work: it is cut
into chunks of ``CHUNK`` rows, each solved from every role that may stand before it to every role it may end in, and those
tables are joined ``FAN_IN`` at a time. Only turns, roles and digests move until the edits are known; then texts go once to
their conversation's task, which streams them into its hash (SHA-256 is one sequence by definition) and holds an audit and a
batch of rows. The driver sees one number a round.

Defined cases: rows of one turn go by role, then by the digest of role and text; a null role or text is one space, and a null
conv_id or turn is one space in the damage's hash; a null turn comes first and counts in no gap; a null conv_id is one
conversation; a role's initial alone decides, and an empty role has none; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgloom.llm import sql
from msgloom.llm._io import materialize, numbered, passing

CHUNK, FAN_IN = 32, 64
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Last role: none yet, system, user, assistant; after each, the one that a new role leads to, and those that a kept one does.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = ("", "system", "user", "assistant")
REACHES = tuple(frozenset(range(s, 4)) if s < USER else frozenset((USER, ASSISTANT)) for s in range(4))
A_CHARACTER, SENTENCE_END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _bounds(codes: str) -> tuple[list[int], list[int]]:
    """What the rows from each on cost at least, once a role stands (and before): each row's cheapest edit, and one edit
    more wherever two neighbours that could be kept have one role."""
    n = len(codes)
    rows, pairs, system, behind = [0] * (n + 1), [0] * (n + 2), [False] * (n + 1), n
    for i in range(n - 1, -1, -1):
        c = codes[i]
        rows[i] = rows[i + 1] + (DELETE if c == "D" or c.isupper() else REROLE if c in "os" else 0)
        system[i] = system[i + 1] or c == "s"
        pairs[i] = pairs[i + 1]
        if c in "ua":
            if behind < n and codes[behind] == c:
                pairs[i] = max(pairs[i], 1 + pairs[behind + 1])
        if c in "uaos":
            behind = i
    after = [rows[i] + pairs[i] for i in range(n + 1)]
    return after, [x - REROLE * s for x, s in zip(after, system)]


@lru_cache(1 << 14)
def cheapest(codes: str, entry: int, exits: frozenset[int]) -> tuple[int, str] | None:
    """Least (cost, audit) from ``entry`` through all rows to one of ``exits``.

    A row's code is its role's initial (``o``: another), in upper case if its text is truncated; ``D`` if it must go.
    """
    after, before = _bounds(codes)

    def bound(node: tuple[int, str, int, int]) -> int:
        return node[0] + (before if node[3] == START else after)[node[2]]

    def search(most: float, order: Callable, strict: bool) -> Iterator[tuple[int, str]]:
        """Ends found depth first, the first child in order on top, while they cost at most ``most`` (``strict``: less than those before)."""
        least: dict[tuple[int, int], int] = {}
        stack = [(0, "", 0, entry)]
        while stack:
            node = stack.pop()
            cost, audit, i, last = node
            if bound(node) > most or least.get((i, last), cost + 1) <= cost:
                continue
            least[i, last] = cost
            if i == len(codes) and last in exits:
                yield cost, audit
                most = cost - 1 if strict else most
            nodes = [x for x in _edited(codes, node) if not exits.isdisjoint(REACHES[x[3]])]
            stack += sorted(nodes, key=order, reverse=True)

    found = list(search(float("inf"), lambda x: (bound(x), x[1]), True))
    return next(search(found[-1][0], lambda x: x[1], False)) if found else None


def _edited(codes: str, node: tuple[int, str, int, int]) -> Iterator[tuple[int, str, int, int]]:
    """The nodes that one edit more leads to."""
    cost, audit, i, last = node
    yield cost + INSERT, audit + "I", i, DUE[last]
    if i < len(codes):
        c = codes[i]
        yield cost + DELETE, audit + "D", i + 1, last
        if c != "D":
            own = cost + TRUNCATED * c.isupper()
            yield own + REROLE, audit + "R", i + 1, DUE[last]
            if (to := KEPT[last].get(c.lower())) is not None:
                yield own, audit + "K", i + 1, to


WHOLE = frozenset((START, ASSISTANT))
_TABLE = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
_RECORD = f"conv_id {{}}, part long, size long, first string, last string, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, edits {_TABLE}"
_LEGAL = {"su", "ua", "au"}


def _table(codes: str, alone: bool) -> list[dict]:
    """The edits through a chunk: from every last role to every one, or only those of a whole conversation."""
    if alone:
        cost, audit = cheapest(codes, START, WHOLE)
        return [{"entry": START, "exit": ASSISTANT, "cost": cost, "audit": audit}]
    found = [(entry, to, cheapest(codes, entry, frozenset((to,)))) for entry in range(4) for to in REACHES[entry]]
    return [{"entry": entry, "exit": to, "cost": x[0], "audit": x[1]} for entry, to, x in found if x]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, codes = batch.column("roles").to_pylist(), batch.column("codes").to_pylist()
        illegal = [sum(r[i : i + 2] not in _LEGAL for i in range(len(r) - 1)) for r in roles]
        edits = [_table(c, a) for c, a in zip(codes, batch.column("alone").to_pylist())]
        own = [pa.array(x, t) for x, t in (([r[0] for r in roles], pa.string()), ([r[-1] for r in roles], pa.string()), (illegal, pa.int64()), (edits, _EDITS))]
        columns = dict(zip(batch.schema.names, batch.columns)) | dict(zip(("first", "last", "illegal", "edits"), own))
        names = [x.split()[0] for x in _RECORD.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


_EDITS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _joined(a: dict, b: dict) -> dict:
    """Two neighbouring stretches of a conversation as one."""
    edits: dict[tuple[int, int], tuple[int, str]] = {}
    for x in a["edits"]:
        for y in b["edits"]:
            if x["exit"] == y["entry"]:
                key, own = (x["entry"], y["exit"]), (x["cost"] + y["cost"], x["audit"] + y["audit"])
                edits[key] = min(own, edits.get(key, own))
    out = {k: a[k] + b[k] for k in ("size", "blank", "duplicate", "truncated")}
    turns = [x for x in (a["least"], b["least"], a["most"], b["most"]) if x is not None]
    out |= {"least": min(turns, default=None), "most": max(turns, default=None), "first": a["first"], "last": b["last"]}
    out["turns"] = a["turns"] + b["turns"] - (a["most"] is not None and a["most"] == b["least"])
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in _LEGAL)
    return out | {"edits": [{"entry": e, "exit": x, "cost": c, "audit": s} for (e, x), (c, s) in edits.items()]}


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            part, *others = sorted(row["parts"], key=lambda x: x["part"])
            for other in others:
                part = _joined(part, other)
            row |= part | {"part": row["up"]}
        names = [x.split()[0] for x in _RECORD.split(", ")]
        columns = [batch.column("conv_id")] + [pa.array([r[c] for r in rows], _EDITS if c == "edits" else pa.string() if c in ("first", "last") else pa.int64()) for c in names[1:]]
        yield pa.RecordBatch.from_arrays(columns, names)


def repairs(rows: DataFrame, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of rows ``conv_id, turn, role, digest, fault``.

    ``fault`` is 1 if the text is blank, 2 if it is truncated, else 0; ``digest`` tells roles and texts apart.
    """
    kind = _RECORD.format(rows.schema["conv_id"].dataType.simpleString())
    own = numbered(rows, "conv_id", ["turn", "role", "digest"], "repair-rows")
    again = own.filter("fault != 1").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("index").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    own = own.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    repeat = F.col("fault").isin(0, 2) & (F.col("index") > F.col("_first"))
    fault = F.when(F.coalesce(repeat, F.lit(False)), 3).otherwise(F.col("fault"))
    code = F.when(fault.isin(1, 3), "D").when(fault == 2, F.upper(role)).otherwise(role)
    one = own.select("conv_id", F.floor(F.col("index") / chunk).cast("long").alias("part"), "index", F.col("turn").cast("long").alias("turn"), role.alias("role"), fault.alias("fault"), code.alias("code"))
    of = lambda c: F.array_join(F.transform("rows", lambda x: x[c]), "")
    many = lambda k: F.count_if(F.col("fault") == k).alias(("", "blank", "truncated", "duplicate")[k])
    chunks = one.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("index", "role", "code"))).alias("rows"), F.count("*").alias("size"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.size(F.collect_set("turn")).cast("long").alias("turns"), many(1), many(2), many(3))
    chunks = chunks.select("conv_id", "part", "size", "least", "most", "turns", "blank", "duplicate", "truncated", of("role").alias("roles"), of("code").alias("codes"))
    alone = (F.col("part") == 0) & (F.col("size") < chunk)
    found = materialize(chunks.withColumn("alone", alone).mapInArrow(_solved, kind), "repair-chunks")
    done, parts = found.filter(alone), found.filter(~alone)
    while (parts.agg(F.max("part")).head()[0] or 0) > 0:
        up = parts.groupBy("conv_id", F.floor(F.col("part") / fan_in).cast("long").alias("up")).agg(F.collect_list(F.struct(*(c for c in parts.columns if c != "conv_id"))).alias("parts"))
        parts = materialize(up.mapInArrow(_merged, kind), "repair-parts")
    whole = done.unionByName(parts)
    ends = F.filter("edits", lambda x: (x["entry"] == START) & x["exit"].isin(*WHOLE))
    best = F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


class Repaired:
    """The rows of one conversation after its edits, in order, one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, START

    def _due(self) -> str:
        self.last = DUE[self.last]
        return ROLES[self.last]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._due(), ""

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._due(), text
        elif edit == "K":
            self.last = KEPT[self.last][role[:1]]
            yield role, text


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations one behind another: first its edits, then its rows in order."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    head: dict | None = None
    edits, digest, any_ = Repaired(""), hashlib.sha256(), False

    def take(rows: Iterator[tuple[str, str]]) -> None:
        nonlocal any_
        for role, text in rows:
            digest.update((("\n" if any_ else "") + f"{role}:{text}").encode())
            any_ = True

    def closed() -> list:
        take(edits.inserted())
        return [head["conv_id"], *(head[c] or 0 for c in _COUNTS), head["audit"] or "", digest.hexdigest()]

    kind = None
    for batch in batches:
        kind, out = batch.column("conv_id").type, []
        for row in batch.to_pylist():
            if head is None or head["conv_id"] != row["conv_id"]:
                if head is not None:
                    out.append(closed())
                head, edits, digest, any_ = row, Repaired(row["audit"] or ""), hashlib.sha256(), False
            if row["step"] == 1:
                take(edits.edited(row["role"], row["text"]))
        yield _batch(out, names, kind)
    if head is not None:
        yield _batch([closed()], names, kind)


def _batch(rows: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def fate(conv_id: Column, turn: Column) -> Column:
    """Which of 20 fates a row has: 0 lost, 1 emptied, 2 without sentence ends, 3 twice, 4 said by the user."""
    return F.crc32(F.concat(_or_space(conv_id), F.lit(":"), _or_space(turn)).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with known damage, and ``lost`` for rows that are no more."""
    own = conversations.select("conv_id", "turn", _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"), fate(F.col("conv_id"), F.col("turn")).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("lost"), times).drop("time")


def repaired(rows: DataFrame, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits, and the digest of what they lead to.

    ``rows`` are ``conv_id, turn, role, text, lost``; of lost rows only the conversation counts.
    """
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    there = rows.filter("not lost").select("conv_id", "turn", "role", "text", digest.alias("digest"))
    fault = F.when(~F.col("text").rlike(A_CHARACTER), 1).when(~F.col("text").rlike(SENTENCE_END), 2).otherwise(0)
    with passing() as keep:
        heads = repairs(there.select("conv_id", "turn", "role", "digest", fault.alias("fault")), chunk, fan_in)
        stream = heads.withColumn("step", F.lit(0)).unionByName(there.withColumn("step", F.lit(1)), allowMissingColumns=True)
        stream = stream.unionByName(rows.filter("lost").select("conv_id", F.lit(2).alias("step")), allowMissingColumns=True)
        dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "digest")
        schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
        return keep(materialize(dealt.mapInArrow(_streamed, schema), "repaired"))


ORACLE_SQL = """
WITH RECURSIVE fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fate FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS row_key FROM conversations)),
there AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, (SELECT unnest([1, 2]) AS time) WHERE fate != 0 AND (time = 1 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS i, substr(role, 1, 1) AS initial FROM there),
seen AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND again) AS duplicate,
    count_if(NOT blank AND NOT again AND cut) AS truncated, count_if(i > 1 AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM seen GROUP BY conv_id),
-- states: 0 none, 1 system, 2 user, 3 assistant; up to two rows inserted before an edit or at the end
inserts(st, mid, fee, mark, extra) AS (
  SELECT st, st, 0, '', '' FROM range(4) r(st)
  UNION ALL SELECT st, CASE st WHEN 2 THEN 3 ELSE 2 END, 5, 'I', CASE st WHEN 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END FROM range(4) r(st)
  UNION ALL SELECT st, CASE st WHEN 2 THEN 2 ELSE 3 END, 10, 'II', CASE st WHEN 2 THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END FROM range(4) r(st)),
edits(mark) AS (VALUES ('K'), ('R'), ('D')),
best AS (
  SELECT conv_id, 0 AS i, 0 AS st, {'cost': 0, 'audit': '', 'said': ''} AS b FROM counted
  UNION ALL
  SELECT conv_id, i, st, min({'cost': cost, 'audit': audit, 'said': said}) FROM (
    SELECT p.conv_id, p.i, CASE e.mark WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END ELSE CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS st,
      b.cost + fee + CASE e.mark WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN cut AND e.mark != 'D' THEN 5 ELSE 0 END AS cost,
      b.audit || x.mark || e.mark AS audit,
      b.said || extra || CASE e.mark WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || text ELSE chr(10) || role || ':' || text END AS said
    FROM best JOIN seen p ON best.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = best.i + 1 JOIN inserts x ON x.st = best.st, edits e
    WHERE e.mark = 'D' OR NOT (blank OR again) AND (e.mark = 'R' OR (initial = 's' AND mid = 0) OR (initial = 'u' AND mid != 2) OR (initial = 'a' AND mid = 2))
  ) GROUP BY conv_id, i, st),
ended AS (
  SELECT c.conv_id, min({'cost': b.cost + fee, 'audit': b.audit || mark, 'said': b.said || extra}) AS b
  FROM counted c JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND i = n JOIN inserts x ON x.st = best.st WHERE mid IN (0, 3) GROUP BY c.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("{crc}", sql.crc32("row_key"))
