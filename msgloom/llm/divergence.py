"""Quality rules by distribution divergence: documents against references of their languages.

A reference is what all text of a language looks like: the shares of eight character classes, and those of its common words
(``COMMON`` or more of its words; all others count together). A document is kept if, for one reference, the Jensen-Shannon
distances of both its own histograms are within their limits. A histogram of ``n`` draws from the reference itself lies
about ``(bins - 1) / (8 n ln 2)`` of divergence away, which the limit on words allows for. Histograms of fewer than
``LEAST_CHARS`` characters or ``LEAST_WORDS`` words are not judged.

Three steps, all over every text: a bounded summary of word counts a language (each batch's ``KEEP`` most frequent words
less the next one's count; whatever a word loses is at most one in ``KEEP``) names all words that can be common; a narrow
pass writes each document's rule counts, class counts and counts of those words, no text; their exact sums are the
references, and a narrow pass over them gives the verdicts. Only counts are shuffled, summed where they arise. Broadcasts
are bounded: a language has a reference of its own from ``LEAST_SHARE`` of all words (1,000 languages at most), and words
that can be common are at most ``KEEP`` of each. Words and lines are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words and fails the base rules; languages without a reference of their own, and a
null ``lang``, have one together if they hold ``LEAST_REFERENCE`` words, else their documents are not judged; a tie with a
limit is kept; rows with equal doc_id are judged one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, materialize, passing, pieces_of, text_or_empty
from msgloom.llm.pieces import span_hashes
from msgloom.llm.words import mix

#: One in so many words of a language is common; one in so many words of all is a language's least share.
COMMON, LEAST_SHARE = 500, 1000
KEEP = 1024
LEAST_CHARS, LEAST_WORDS, LEAST_REFERENCE = 200, 50, 5000
#: Largest distance of character classes, and of common words beyond what their number alone explains.
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.30
BATCH_BYTES = 1 << 20

LOWER, UPPER, DIGIT, LINE, WHITE, STOP, SYMBOL, OTHER, WITHIN = range(9)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = WITHIN
_CLASS[0x21:0x7F] = SYMBOL
_CLASS[list(b".,;:!?'\"()-")] = STOP
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A] = WHITE, LINE
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Texts:
    """Words, tokens and lines of texts laid end to end (``offsets`` from 0)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.kind = _CLASS[data]
        blank = (self.kind == WHITE) | (self.kind == LINE)
        self.starts, self.ends = self._runs(~blank)
        self.words = np.diff(np.searchsorted(self.starts, offsets))
        self.doc = np.repeat(np.arange(self.n), self.words)

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        starts = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
        ends = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.offsets])

    def classes(self) -> np.ndarray:
        return np.stack([self.per_text(self.kind == k) for k in range(WITHIN)], axis=1)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that have a letter, without the signs around them: which words they are, their starts and ends."""
        plain = (self.kind != STOP) & (self.kind != SYMBOL)
        at = np.arange(len(plain))
        following = np.minimum.accumulate(np.where(plain, at, len(at))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(plain, at, -1))
        a, b = following[self.starts], before[self.ends - 1] + 1
        letters = np.concatenate([[0], np.cumsum((self.kind == LOWER) | (self.kind == UPPER) | (self.data >= 0x80))])
        word = np.flatnonzero((a < b) & (letters[np.minimum(b, len(at))] > letters[np.minimum(a, len(at))]))
        return word, a[word], b[word]

    def repeated_words(self) -> np.ndarray:
        """Words of each text in windows of three that it holds twice or more."""
        h = span_hashes(self.data, self.starts, self.ends)
        if len(h) < 3:
            return np.zeros(self.n, np.int64)
        own = self.doc[:-2] == self.doc[2:]
        windows = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + mix(self.doc[:-2].astype(np.uint64))
        at = np.flatnonzero(own)
        _, which, many = np.unique(windows[at], return_inverse=True, return_counts=True)
        twice = at[many[which] > 1]
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[twice + k] = True
        return np.bincount(self.doc[hit], minlength=self.n)

    def repeated_lines(self) -> np.ndarray:
        """Lines of each text that have a word and equal an earlier one."""
        a, b = self._runs(self.kind != LINE)
        word = np.searchsorted(self.starts, b) > np.searchsorted(self.starts, a)
        a, b = a[word], b[word]
        doc = np.searchsorted(self.offsets, a, "right") - 1
        h = span_hashes(self.data, a, b) + mix(doc.astype(np.uint64))
        _, first = np.unique(h, return_index=True)
        again = np.ones(len(h), bool)
        again[first] = False
        return np.bincount(doc[again], minlength=self.n)


def _texts(batch: pa.RecordBatch, most_bytes: int) -> Iterator[tuple[int, int, Texts]]:
    data, offsets = buffer_of(batch.column("text"))
    for start, end in pieces_of(batch, "text", most_bytes):
        yield start, end, Texts(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n, slack``: the most frequent words of a batch less what they may lack, and (word null) all words."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        for start, end, texts in _texts(batch, 2 * BATCH_BYTES):
            known = {x: i for i, x in enumerate(dict.fromkeys(names[start:end]))}
            lang = np.asarray([known[x] for x in names[start:end]], np.int64)
            word, a, b = texts.tokens()
            folded = _FOLD[texts.data]
            h, of = span_hashes(folded, a, b), lang[texts.doc[word]]
            order = np.lexsort((h, of))
            h, of, a, b = h[order], of[order], a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(h)))
            totals = np.bincount(lang, texts.words, len(known)).astype(np.int64)
            out: list[tuple] = []
            for name, i in known.items():
                at, to = np.searchsorted(of[new], (i, i + 1))
                counts = n[at:to]
                less = int(np.partition(counts, -KEEP - 1)[-KEEP - 1]) if len(counts) > KEEP else 0
                for k in at + np.flatnonzero(counts > less):
                    out.append((name, folded[a[new[k]] : b[new[k]]].tobytes(), int(n[k]) - less, 0))
                out.append((name, None, int(totals[i]), less))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["lang", "word", "n", "slack"])


@dataclass
class References:
    """``words`` (hashes, ascending) that can be common; for each language its classes' shares and its common words'."""

    names: list[str]
    classes: np.ndarray
    common: np.ndarray


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)


def common_words(docs: DataFrame) -> tuple[list[str], list[bytes]]:
    """The languages with a reference of their own, and all words that can be common in one or in the others together."""
    rows = text_or_empty(docs.withColumn("lang", F.col("lang").cast("string")), "lang").mapInArrow(_summary, "lang string, word binary, n long, slack long")
    summed = materialize(rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")), "divergence-words")
    totals = summed.filter("word is null")
    everything = totals.agg(F.sum("n")).head()[0] or 0
    large = totals.filter(F.col("lang").isNotNull() & (F.col("n") * LEAST_SHARE >= everything) & (F.col("n") > 0))
    languages = sorted(r["lang"] for r in large.select("lang").collect())  # LEAST_SHARE at most
    name = F.when(F.col("lang").isin(languages), F.col("lang")).otherwise("")
    pooled = summed.withColumn("lang", name).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    of = pooled.filter("word is null").select(F.col("lang").alias("of"), F.col("n").alias("total"), F.col("slack").alias("lost"))
    able = pooled.filter("word is not null").join(F.broadcast(of), F.col("lang") == F.col("of")).filter((F.col("n") + F.col("lost")) * COMMON >= F.col("total"))
    return languages, sorted(bytes(r["word"]) for r in able.select("word").distinct().collect())


def features(docs: DataFrame, languages: list[str], words: list[bytes]) -> DataFrame:
    """Per document its language (or the empty name), the rules' counts, class counts, and how often it says which of ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(_hashes(words)) if words else np.zeros(0, np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able = shared.value
        for batch in batches:
            for start, end, texts in _texts(batch, BATCH_BYTES):
                classes = texts.classes()
                signs, blank = texts.per_text(_SIGN[texts.data]), classes[:, WHITE] + classes[:, LINE]
                rules = [texts.words, classes.sum(axis=1) - blank, signs, texts.repeated_lines(), texts.repeated_words()]
                word, a, b = texts.tokens()
                doc = slot = n = np.zeros(0, np.int64)
                if len(able):
                    h = span_hashes(_FOLD[texts.data], a, b)
                    slot = np.minimum(np.searchsorted(able, h), len(able) - 1)
                    hit = able[slot] == h
                    key, n = np.unique(texts.doc[word[hit]] * len(able) + slot[hit], return_counts=True)
                    doc, slot = key // len(able), key % len(able)
                at = pa.array(np.searchsorted(doc, np.arange(texts.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (slot, n)]
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * texts.n + 1, 8, dtype=np.int32)), pa.array(classes.reshape(-1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, end - start) for c in ("doc_id", "lang")), *(pa.array(x.astype(np.int64)) for x in rules), each, *lists], ["doc_id", "lang", *_RULES, "classes", "slots", "counts"])

    name = F.when(F.col("lang").cast("string").isin(languages), F.col("lang").cast("string")).otherwise("")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = text_or_empty(docs.withColumn("lang", name), "doc_id", "lang")
    return rows.mapInArrow(count, f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in _RULES)}, classes array<long>, slots array<int>, counts array<int>")


def references(own: DataFrame, words: int) -> References:
    """From the (written) features of all documents."""
    each = [F.sum(F.element_at("classes", k + 1)).alias(f"c{k}") for k in range(WITHIN)]
    totals = {r["lang"]: r for r in own.groupBy("lang").agg(F.sum("n_words").alias("n"), *each).collect()}  # LEAST_SHARE + 1 at most
    names = sorted(x for x, r in totals.items() if r["n"] > 0 and (x or r["n"] >= LEAST_REFERENCE))
    classes = np.asarray([[totals[x][f"c{k}"] for k in range(WITHIN)] for x in names], float).reshape(-1, WITHIN)
    said = own.select("lang", F.explode(F.arrays_zip("slots", "counts")).alias("x")).groupBy("lang", F.col("x.slots").alias("slot")).agg(F.sum("x.counts").alias("n"))
    common = np.zeros((len(names), words))
    at = {x: i for i, x in enumerate(names)}
    for r in said.collect():  # languages x words that can be common
        if r["lang"] in at and COMMON * r["n"] >= totals[r["lang"]]["n"]:
            common[at[r["lang"]], r["slot"]] = r["n"] / totals[r["lang"]]["n"]
    return References(names, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), common)


def _parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each bin's part of the Jensen-Shannon divergence (base 2)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)) / 2


def distances(n_words: np.ndarray, classes: np.ndarray, doc: np.ndarray, slot: np.ndarray, n: np.ndarray, against: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of classes and of common words for documents x references, and the number of each reference's bins of words.

    ``doc, slot, n``: how often which document says which word.
    """
    shares = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
    by_class = np.stack([np.sqrt(np.maximum(_parts(shares, q).sum(axis=1), 0)) for q in against.classes], axis=1)
    by_word = np.zeros_like(by_class)
    share = n / np.maximum(n_words, 1)[doc]
    for k, q in enumerate(against.common):
        own = np.flatnonzero(q[slot] > 0)
        d, p, r = doc[own], share[own], q[slot[own]]
        met = np.bincount(d, _parts(p, r), len(n_words))
        unsaid = (q.sum() - np.bincount(d, r, len(n_words))) / 2
        rest = _parts(np.maximum(1 - np.bincount(d, p, len(n_words)), 0), np.full(len(n_words), 1 - q.sum()))
        by_word[:, k] = np.sqrt(np.maximum(met + unsaid + rest, 0))
    return by_class, by_word, (against.common > 0).sum(axis=1) + 1


def judged(own: DataFrame, against: References) -> DataFrame:
    """The contract's counts and verdicts, with the distances to the nearest reference (null if not judged)."""
    shared = own.sparkSession.sparkContext.broadcast(against)
    kept = ["doc_id", *_RULES]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in batches:
            rows = batch.num_rows
            words, repeats = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
            failed = (words < 50) | (100 * repeats > 50 * words)
            good, near = np.ones(rows, bool), np.full((2, rows), np.nan)
            if refs.names and rows:
                flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("classes", "slots", "counts")]
                sizes = batch.column("slots").value_lengths().to_numpy(zero_copy_only=False)
                classes = flat[0].reshape(-1, WITHIN)
                by_class, by_word, bins = distances(words, classes, np.repeat(np.arange(rows), sizes), flat[1], flat[2], refs)
                noise = (bins - 1)[None, :] / (8 * np.log(2) * np.maximum(words, 1)[:, None])
                long, many = classes.sum(axis=1) >= LEAST_CHARS, words >= LEAST_WORDS
                fits = (~long[:, None] | (by_class <= CLASS_LIMIT)) & (~many[:, None] | (by_word <= np.sqrt(WORD_LIMIT**2 + noise)))
                named = np.isin(np.asarray(batch.column("lang").to_pylist(), object), refs.names)
                good = fits.any(axis=1) | ~named
                nearest = by_class.argmin(axis=1), by_word.argmin(axis=1)
                near = np.stack([np.where(long, by_class[np.arange(rows), nearest[0]], np.nan), np.where(many, by_word[np.arange(rows), nearest[1]], np.nan)])
            found = [pa.array(failed), pa.array(good & ~failed), *(pa.array(x, mask=np.isnan(x)) for x in near)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "base_failed", "kept", "class_distance", "word_distance"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{c} long' for c in _RULES)}, base_failed boolean, kept boolean, class_distance double, word_distance double")


def quality(docs: DataFrame) -> DataFrame:
    """One row a document: base counts and failures, whether it is kept, and its distances."""
    with passing() as keep:
        languages, words = common_words(docs)
        own = materialize(features(docs, languages, words), "divergence-features")
        return keep(materialize(judged(own, references(own, len(words))), "divergence"))


_SIGNS = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
_CLASSES = ["a-z", "A-Z", "0-9", r"\x0A", r"\x20\x09\x0B-\x0D", r"\x21\x22\x27-\x29\x2C-\x2E\x3A\x3B\x3F", r"\x23-\x26\x2A\x2B\x2F\x3C-\x3E\x40\x5B-\x60\x7B-\x7E", r"\x00-\x08\x0E-\x1F\x7F-\x{10FFFF}"]
_LISTED = ", ".join(f"'{x}'" for x in _CLASSES)
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
said AS (SELECT rid, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM docs)),
sizes AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM said GROUP BY rid),
windows AS (SELECT rid, i, w, count(*) OVER (PARTITION BY rid, w) AS many FROM
  (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS w FROM said WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE w IS NOT NULL),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(3) r(k) WHERE many > 1 GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
based AS (
  SELECT rid, doc_id, lang, text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)),
large AS (SELECT lang FROM based GROUP BY lang HAVING lang IS NOT NULL AND sum(n_words) > 0 AND sum(n_words) * {LEAST_SHARE} >= (SELECT sum(n_words) FROM based)),
named AS (SELECT *, CASE WHEN lang IN (FROM large) THEN lang ELSE '' END AS name FROM based),
refs AS (SELECT name AS ref, sum(n_words) AS total FROM named GROUP BY name HAVING sum(n_words) > 0 AND (name != '' OR sum(n_words) >= {LEAST_REFERENCE})),
tokens AS (SELECT rid, token, count(*) AS n FROM
  (SELECT rid, translate(regexp_replace(regexp_replace(word, '^[{_SIGNS}]+', ''), '[{_SIGNS}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS token FROM said)
  WHERE regexp_matches(token, '[a-z]|[^\x00-\x7F]') GROUP BY rid, token),
common AS (SELECT ref, token, sum(n) / any_value(total) AS q FROM tokens JOIN named USING (rid) JOIN refs ON ref = name GROUP BY ref, token HAVING {COMMON} * sum(n) >= any_value(total)),
mass AS (SELECT ref, coalesce(sum(q), 0) AS q, count(q) AS bins FROM refs LEFT JOIN common USING (ref) GROUP BY ref),
met AS (SELECT rid, ref, sum(n / n_words) AS p, sum(q) AS q, sum(n / n_words * log2(2 * (n / n_words) / (n / n_words + q)) + q * log2(2 * q / (n / n_words + q))) / 2 AS js
  FROM tokens JOIN common USING (token) JOIN named USING (rid) GROUP BY rid, ref),
by_word AS (
  SELECT rid, ref, bins, js + (mass_q - q) / 2 + (CASE WHEN p < 1 THEN (1 - p) * log2(2 * (1 - p) / (2 - p - mass_q)) ELSE 0 END + CASE WHEN mass_q < 1 THEN (1 - mass_q) * log2(2 * (1 - mass_q) / (2 - p - mass_q)) ELSE 0 END) / 2 AS js
  FROM (SELECT rid, mass.ref, bins, mass.q AS mass_q, coalesce(met.p, 0) AS p, coalesce(met.q, 0) AS q, coalesce(js, 0) AS js FROM named CROSS JOIN mass LEFT JOIN met USING (rid, ref) WHERE n_words > 0)),
counted AS (SELECT rid, name, k, length(regexp_replace(text, '[^' || class || ']', '', 'g')) AS n, greatest(length(text), 1) AS chars FROM named, (SELECT unnest([{_LISTED}]) AS class, unnest(range(8)) AS k)),
shares AS (SELECT name AS ref, k, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY name), 1) AS q FROM counted WHERE name IN (SELECT ref FROM refs) GROUP BY name, k),
by_class AS (SELECT rid, ref, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js
  FROM (SELECT rid, k, n / chars AS p FROM counted) JOIN shares USING (k) GROUP BY rid, ref),
fitting AS (
  SELECT DISTINCT rid FROM named JOIN by_class c USING (rid) JOIN by_word w USING (rid, ref)
  WHERE (length(text) < {LEAST_CHARS} OR sqrt(greatest(c.js, 0)) <= {CLASS_LIMIT})
    AND (n_words < {LEAST_WORDS} OR sqrt(greatest(w.js, 0)) <= sqrt({WORD_LIMIT}::DOUBLE ^ 2 + bins / (8 * ln(2) * n_words))))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND (rid IN (FROM fitting) OR name NOT IN (SELECT ref FROM refs)) AS kept
FROM named
"""
