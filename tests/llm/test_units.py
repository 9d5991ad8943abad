"""The training-data operators' cores against brute force, on small inputs and without Spark."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from msgloom.llm import ann_graph, decontaminate, hilbert_pack, langid_ppm, probminhash, rans_ids, suffix_dedup, url_filter
from msgloom.llm._io import buffer_of
from msgloom.llm.pieces import encoder_for
from msgloom.llm.queries import tokenizer_path
from msgloom.llm.suffix_array import permuted_lcp, suffix_array
from msgloom.llm.words import shingles, weighted, word_hashes

ODD = ["", " a", "a  b", "x\n\n y", "a b c", "\n\n b d", "hi <|endoftext|> yo", " ", "\n", "a \nb", "tab\tb c", "▁a b", "a▁ b", "<s> hey </s>", "\x00 a b", "don't we'll 12 34,5", "é à ü", "日本語 テキスト。", "a b ", "b  ", "\x1c a b", "a\x1c b", "x 　y z", "é ́x", "word " * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_pieces_give_the_ids_of_whole_texts(name):
    encoder = encoder_for(tokenizer_path(name))
    data, offsets = buffer_of(pa.array(ODD * 2))
    counts, ids = encoder.runs(data, offsets)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [list(x) for x in encoder.encode(ODD * 2)]


def test_piece_table_starts_anew_when_full():
    from msgloom.llm.pieces import PieceEncoder, PieceTable

    encoder = PieceEncoder(lambda texts: [[len(x), ord(x[-1])] for x in texts], False, False, lambda d, s, n: n[:0])
    encoder.table = PieceTable(bits=5)
    for k in range(20):
        text = " ".join(f"w{k}{j}" for j in range(9))
        data, offsets = buffer_of(pa.array([text]))
        counts, ids = encoder.runs(data, offsets)
        assert counts[0] == len(ids) and len(ids) == 18


def test_rans_round_trip_checksum_and_skew():
    r = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (7, 3), (5000, 300), (300_000, 40_000)):
        ids = (r.zipf(1.3, n) % top).astype(np.int64)
        sizes = np.asarray([n // 3, n - n // 3 - n // 5, n // 5])
        symbols, counts = np.unique(np.append(ids, 0), return_counts=True)
        table = rans_ids.Table(symbols, rans_ids.scale_counts(symbols, counts))
        frame = rans_ids.encode_frame(ids, np.asarray([5, 6, 0]), np.asarray([True, True, False]), sizes, table)
        back, docs, valid, got = rans_ids.decode_frame(frame, table)
        assert back.tolist() == ids.tolist() and docs.tolist() == [5, 6, 0] and valid.tolist() == [1, 1, 0] and got.tolist() == sizes.tolist()
        with pytest.raises(ValueError):
            rans_ids.decode_frame(frame[:-9] + bytes([frame[-9] ^ 1]) + frame[-8:], table)


def test_hilbert_neighbours_touch():
    side = 8
    points = np.asarray([[x, y] for x in range(side) for y in range(side)])
    key = hilbert_pack.hilbert_index(points, 3)
    assert sorted(key) == list(range(side * side))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for t in range(150):
        s = r.integers(0, int(r.integers(1, 5)), int(r.integers(1, 60)))
        s = np.tile(s, 3) if t % 3 == 0 else s
        b = bytes((s + 97).tolist())
        want = sorted(range(len(b)), key=lambda i: b[i:])
        data = np.frombuffer(b, np.uint8)
        assert suffix_array(data, 256).tolist() == want and suffix_array(data, 5000).tolist() == want
        p = permuted_lcp(data, np.asarray(want))
        for x, y in zip(want, want[1:]):
            n = 0
            while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert p[y] == n


def brute_repeats(texts, m):
    seen = defaultdict(int)
    for b in texts:
        for k in range(len(b) - m + 1):
            seen[b[k : k + m]] += 1
    out = []
    for b in texts:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - m + 1):
            if seen[b[k : k + m]] > 1:
                cover[k : k + m] = True
        out.append((len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()))
    return out


def test_anchors_meet_in_equal_strings():
    r = np.random.default_rng(2)
    m, passage = 40, bytes(r.integers(97, 101, 45).astype(np.uint8))
    texts = [bytes(r.integers(97, 101, int(k)).astype(np.uint8)) + passage + bytes(r.integers(97, 101, int(k)).astype(np.uint8)) for k in r.integers(0, 90, 20)]
    sizes = np.asarray([len(x) for x in texts])
    doc, g, s, first, at, last = suffix_dedup.anchors(np.frombuffer(b"".join(texts), np.uint8), sizes, m)
    under = defaultdict(set)
    for d, text in enumerate(texts):
        own = doc == d
        held = sorted(k for a, b in zip(first[own], last[own]) for k in range(a, b - m + 1))
        assert held == list(range(max(0, len(text) - m + 1)))  # every string has one anchor
        for hash_, a, place, b in zip(g[own].tolist(), first[own], at[own], last[own]):
            for k in range(a, b - m + 1):
                assert k <= place and place + suffix_dedup.gram_bytes(m) <= k + m
                under[text[k : k + m]].add((hash_, place - k))
    assert all(len(x) == 1 for x in under.values())  # and equal strings the same one


def test_ppm_code_length_is_the_recursion():
    rows = {"a": b"banana bandana", "b": b"cabbage"}
    keys, langs = [], []
    for k, text in enumerate(rows.values()):
        own = langid_ppm.byte_strings(np.frombuffer(text, np.uint8), np.asarray([len(text)]))
        keys.append(own)
        langs.append(np.full(len(own), k))
    model = langid_ppm.Model.of(list(rows), np.concatenate(langs), np.concatenate(keys), np.ones(sum(map(len, keys))))

    def bits(train, text):
        padded, total = b"\0" * 4 + train, 0.0
        for i in range(len(text)):
            context = (b"\0" * 4 + text)[i : i + 4]
            p = 1.0
            for order in range(4, -1, -1):
                c = context[4 - order :]
                after = [padded[j] for j in range(4, len(padded)) if padded[j - order : j] == c]
                if not after:
                    continue
                if text[i] in after:
                    p *= after.count(text[i]) / (len(after) + len(set(after)))
                    break
                p *= len(set(after)) / (len(after) + len(set(after)))
            else:
                p /= 256
            total -= np.log2(p)
        return total

    for text in (b"banana", b"cab", b"zebra band", b"x"):
        got = model.code_lengths(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]))[0]
        assert got == pytest.approx([bits(t, text) for t in rows.values()], rel=1e-5)


def test_probminhash_estimates_probability_jaccard():
    r = np.random.default_rng(5)
    a, b = {i: 1 + i % 3 for i in range(200)}, {i: 1 + i % 3 for i in range(30, 230)}
    items = [np.asarray(sorted(x), np.uint64) for x in (a, b)]
    weights = [np.asarray([x[int(i)] for i in y]) for x, y in zip((a, b), items)]
    registers = probminhash.probminhash(np.concatenate(items) * np.uint64(0x9E3779B97F4A7C15), np.concatenate(weights), np.asarray([200, 200]), 4096)
    total = [w.sum() for w in weights]
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a | b) for i in a if i in b)
    assert abs((registers[0] == registers[1]).mean() - exact) < 0.03 and total[0] == total[1]
    assert probminhash.similarity((items[0], weights[0]), (items[1], weights[1])) >= exact - 1e-9
    del r


def test_shingles_of_short_and_repeated_texts():
    data, offsets = buffer_of(pa.array(["", "one two", "a b c d e", "a b c d e f", "a b a b a b a b a b", "--"]))
    found, counts = shingles(*word_hashes(data, offsets))
    assert counts.tolist() == [0, 1, 1, 2, 6, 0]
    _, w, n = weighted(found, counts)
    assert n.tolist() == [0, 1, 1, 2, 2, 0] and sorted(w[-2:].tolist()) == [3, 3]


def test_graph_recall_and_copies():
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 24)) + 2 * r.standard_normal((3000, 1))
    graph, entry, _ = ann_graph.build_graph(x)
    q = x[:150]
    found, _, _ = ann_graph.beam_search(x.astype(np.float32), np.zeros(3000, np.float32), graph.astype(np.int64), q.astype(np.float32), entry, 80)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    score = np.einsum("bcd,bd->bc", x[found], q)
    top = np.take_along_axis(found, np.argsort(-score, axis=1)[:, :20], 1)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(top, best)]) > 0.95
    assert (graph < 3000).all() and (graph >= -1).all()


def test_bloom_words_never_miss():
    from msgloom.llm.url_filter import _bits, _hashes

    keys = pa.array([f"host{i}.com/p" for i in range(500)])
    block, bits = _bits(_hashes(keys), 16)
    words = np.zeros((16, 8), np.uint32)
    np.bitwise_or.at(words, block, bits)
    assert ((words[block] & bits) == bits).all() and len(url_filter.WORD_SALTS) == 8


def test_masks_miss_no_overlap():
    """All ways to lay substitutions into overlaps of 12 to 18 words that begin and end with a same word."""
    from itertools import combinations

    ones = [[i for i, x in enumerate(m) if x == "1"] for m in decontaminate.MASKS]
    for n in range(decontaminate.MIN_WORDS, 19):
        for changed in combinations(range(1, n - 1), n // 4):
            assert any(all(at + i not in changed for i in own) for own in ones for at in range(n - own[-1]))


def test_longest_overlap_is_the_longest():
    r = np.random.default_rng(4)
    for _ in range(300):
        same = r.random(int(r.integers(1, 40))) < r.choice([0.3, 0.6, 0.75, 0.9])
        at = np.flatnonzero(same)
        best = max((int(j - i + 1) for i in at for j in at if j >= i and same[i : j + 1].sum() >= 0.75 * (j - i + 1)), default=0)
        a, b = decontaminate.longest_overlap(same)
        assert b - a == best and (not best or same[a] and same[b - 1] and same[a:b].sum() >= 0.75 * best)
