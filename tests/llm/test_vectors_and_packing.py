"""Whitening, packing and hard negatives against plain versions, and on nulls, ties, repeats, empty tables and extra columns."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import hard_negatives, packing, whitening

VECTORS = "vec_id long, embedding array<double>, label int, x int, row string, v double, n string, component int, rank int"
DOCS = "doc_id long, text string, lang string, length int, row string, bucket int, n long, at long, piece string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, l, 1, "r", 2.0, "n", 3, 4) for i, e, l in rows], VECTORS)


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def floors(e, dim):
    return [math.floor(256 * x) if abs(x) < 2**44 else int(x) * 256 for x in e] + [0] * (dim - len(e))


# Whitening


def whitened_plainly(rows, k=4):
    own = [(i, e) for i, e, _ in rows if usable(e)]
    dim = max(len(e) for _, e in own)
    x = [(i, floors(e, dim)) for i, e in own]
    once = sorted({tuple(v) for _, v in x})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in once])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    out = []
    for i, v in x:
        exact = [n * a - s for a, s in zip(v, sums)]
        w = np.array([a / n for a in exact]) @ components[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
        out += [(i, c + 1, n, sum(a * a for a in exact), w[c], values[c] / values.sum()) for c in range(min(k, dim))]
    return out


def check_whitening(spark, rows, k=4):
    got = whitening.whiten(vectors(spark, rows), k).collect()
    want = whitened_plainly(rows, k)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    mine = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"] if r["deviation"] is not None else int(r["deviation_digits"]), r["whitened"], r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [x[:4] for x in mine] == [x[:4] for x in want]
    np.testing.assert_allclose([x[5] for x in mine], [x[5] for x in want], rtol=1e-6)
    np.testing.assert_allclose([abs(x[4]) for x in mine], [abs(x[4]) for x in want], atol=1e-6)
    for c in range(1, k + 1):  # one sign for all rows
        a, b = np.array([x[4] for x in mine if x[1] == c]), np.array([x[4] for x in want if x[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert all(r["identity_error"] < 1e-9 for r in got)
    return got


def test_whitening_matches_numpy(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(150, 6)) * [3, 2.5, 2, 1, 0.5, 0.1] + 40.0
    rows = [(i, e.tolist(), 0) for i, e in enumerate(base)]
    rows += [(200, base[3].tolist(), 1), (None, base[4].tolist(), None), (3, base[3].tolist(), 0)] * 20  # copies don't weigh
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 0), (304, base[0].tolist()[:3], 0), (305, [], 0)]
    check_whitening(spark, rows)


def test_whitening_stays_exact_far_from_zero(spark):
    """Doubles would cancel here: the spread is 12 digits below the mean."""
    r = np.random.default_rng(4)
    rows = [(i, (2.0**40 + r.integers(-300, 300, size=5) / 256).tolist(), 0) for i in range(90)]
    check_whitening(spark, rows)


def test_whitening_beyond_a_long(spark):
    r = np.random.default_rng(5)
    got = check_whitening(spark, [(i, (r.normal(size=3) * 1e8).tolist(), 0) for i in range(40)], k=3)
    assert all(x["deviation"] is None and int(x["deviation_digits"]) > whitening.LONG for x in got)
    huge = whitening.whiten(vectors(spark, [(1, [1e300, -1e300], 0), (2, [0.0, 0.0], 0), (3, [1.0, 5e18], 0)])).collect()
    assert len(huge) == 6 and all(x["n"] == 3 for x in huge)


def test_whitening_without_variance(spark):
    alike = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alike] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(vectors(spark, [(i, [float(i), 1.0, 2.0 * i], 0) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [], 0), (2, None, 0)])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_popcounts_are_cross_products(seed):
    r = np.random.default_rng(seed)
    ends = [(0, 1), (-300, 300), (-(1 << 40), 1 << 40), (-(1 << 63), (1 << 63) - 1)][seed]
    x = r.integers(*ends, size=(r.integers(1, 200), 4), endpoint=True)
    x[:, 2] = 7  # a constant dimension has no bits
    least = x.min(axis=0).tolist()
    bits = [(int(h) - l).bit_length() for h, l in zip(x.max(axis=0), least)]
    limbs = 2 * max(1, max(bits)) // whitening.LIMB + 1
    sums, products = np.zeros((4, limbs), np.int64), np.zeros((4, limbs, 4), np.int64)
    whitening.scatter(x, least, bits, sums, products)
    y = [[int(a) - l for a, l in zip(row, least)] for row in x]
    whole = lambda limbs_: sum(int(v) << (whitening.LIMB * k) for k, v in enumerate(limbs_))
    assert [whole(s) for s in sums] == [sum(c) for c in zip(*y)]
    for i in range(4):
        for j in range(i, 4):
            assert whole(products[i, :, j]) == sum(row[i] * row[j] for row in y)


# Packing


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


ODD_TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n a", "it's  we'll", "<|endoftext|>", "a  <|endoftext|> b<|endoftext|>", "漢字 тест \x00 😀 a b", "x" * 9000, "a　 b\xa0 c", "one two " * 3000, "tab\t\tand\r\n line \n"]


def odd_documents(spark):
    r = random.Random(2)
    texts = ODD_TEXTS + ["".join(r.choice("ab  \n.é漢'\t\xa0xq1") for _ in range(r.choice([2, 9, 60, 900]))) for _ in range(150)]
    rows = [(k if k % 11 else None, t) for k, t in enumerate(texts)] + [(3, "the same text")] * 40 + [(None, None)] * 5
    return spark.createDataFrame([(*x, "en", 1, "r", 2, 3, 4, "p") for x in rows], DOCS)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_holds_every_piece_once(spark, capacity):
    docs = odd_documents(spark)
    rows = packing.packed(docs, TOKENIZER, capacity, keep_tokens=True).collect()
    encode = library().encode
    want = Counter()
    for d in docs.collect():
        ids = encode(d["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["token_ids"])) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    total = sum(r["length"] for r in rows)
    assert len(held) <= 1.05 * -(-total // capacity) + 1
    assert sorted(held) == list(range(len(held)))


def test_sequences_hold_the_tokens_in_place(spark):
    docs = odd_documents(spark)
    rows = packing.packed(docs, TOKENIZER, 64, keep_tokens=True)
    by_sequence = defaultdict(list)
    for r in rows.collect():
        by_sequence[r["sequence_id"]].append((r["offset"], r["token_ids"]))
    got = {r["sequence_id"]: r["token_ids"] for r in packing.sequences(rows).collect()}
    assert {k: sorted(v) for k, v in by_sequence.items()}.keys() == got.keys()
    assert sum(map(len, got.values())) == sum(len(x) for v in by_sequence.values() for _, x in v)
    assert all(len(x) <= 64 for x in got.values())


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0
    assert packing.patterns({}, 8) == []


def two_fit_plainly(lengths, capacity):
    """Best-two-fit over single pieces."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        bin_, room = [], capacity
        for x in list(left):
            if x <= room:
                bin_.append(x), left.remove(x)
                room -= x
        if room and len(bin_) > 1:
            room += bin_[-1]
            pairs = [(x + y) for a, x in enumerate(left) for y in left[a + 1 :] if bin_[-1] < x + y <= room]
            if pairs:
                best = max(pairs)
                x, y = next((x, y) for a, x in enumerate(left) for y in left[a + 1 :] if x + y == best)
                left.append(bin_.pop()), left.remove(x), left.remove(y)
                left.sort(reverse=True)
                bin_ += [x, y]
        out.append(sum(bin_))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_patterns_pack_as_best_two_fit_does(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 40, 100])
    lengths = [r.randint(1, r.choice([capacity, capacity // 3])) for _ in range(r.choice([5, 40, 160]))]
    found = packing.patterns(Counter(lengths), capacity)
    used = Counter()
    for times, pattern in found:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= capacity
        for x, n in pattern.items():
            used[x] += times * n
    assert used == Counter(lengths)
    plain = two_fit_plainly(lengths, capacity)
    assert abs(sum(t for t, _ in found) - len(plain)) <= 1 + len(plain) // 40  # pairs at a tie differ


def test_patterns_are_few_for_any_number_of_documents():
    r = random.Random(1)
    for n in (10, 10**4, 10**9):
        counts = Counter({r.randint(1, 2047): r.randint(1, n) for _ in range(1500)})
        found = packing.patterns(counts, 2048)
        total = sum(x * c for x, c in counts.items())
        assert len(found) < 5000 and sum(t for t, _ in found) <= 1.03 * total / 2048 + 10
        length, first, sequence, each, place = packing.runs(found)
        assert (np.diff(length * (1 << 44) + first) > 0).all()


# Hard negatives


def negatives_plainly(rows, is_anchor, positives=5, k=10, least=30, most=90):
    own = [(i, l, e) for i, e, l in rows if i is not None and l is not None and usable(e)]
    dim = max([len(e) for _, _, e in own], default=0)
    own = [(i, l, tuple(floors(e, dim))) for i, l, e in own]
    cut = lambda s: max(-hard_negatives.END, min(hard_negatives.END, s))
    out = Counter()
    for i, l, v in sorted({x for x in own if is_anchor(x[0])}):
        scored = [(cut(sum(a * b for a, b in zip(v, w))), j, m) for j, m, w in own if j != i]
        first = sorted(((-s, j) for s, j, m in scored if m == l))[:positives]
        for s, j in first:
            fits = sorted((-t, h) for t, h, m in scored if m != l and least * -s <= 100 * t <= most * -s)[:k]
            for rank, (t, h) in enumerate(fits):
                out[i, j, rank + 1, h, -s, -t] += 1
    return out


def check_negatives(spark, rows, is_anchor, **options):
    column = F.col("vec_id") % is_anchor == 0
    got = hard_negatives.hard_negatives(vectors(spark, rows), column, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    plain = {x: y for x, y in options.items() if x not in ("block", "anchor_block")}
    want = negatives_plainly(rows, lambda i: i % is_anchor == 0, **plain)
    assert Counter(tuple(r) for r in got.collect()) == want
    return want


def test_hard_negatives_match_brute_force(spark):
    r = np.random.default_rng(7)
    centre = r.normal(size=(6, 5)) * 3
    rows = [(i, (centre[i % 6] + r.normal(size=5)).tolist(), int(r.integers(0, 4)) if r.random() < 0.6 else 1) for i in range(600)]
    rows += [(None, [1.0] * 5, 1), (700, None, 1), (707, [1.0, None, 1.0], 1), (714, [float("nan")] * 5, 2), (721, [1.0] * 5, None), (728, [2.0, 1.0], 1), (735, [], 2)]
    rows += [rows[7], rows[14], rows[14], (21, [9.0, 1.0, 0.0, 0.0, 0.0], 2)]  # repeats, and an id with two vectors
    assert len(check_negatives(spark, rows, 7, block=40, anchor_block=16)) > 500
    check_negatives(spark, rows, 7, positives=2, k=3, least=10, most=100)


def test_hard_negatives_with_ties_and_copies(spark):
    r = np.random.default_rng(8)
    grid = [(i, r.integers(-2, 3, size=3).astype(float).tolist(), int(i % 3)) for i in range(260)]
    copies = [(1000 + i, [1.0, 2.0, 0.5], int(i % 2)) for i in range(180)]
    assert len(check_negatives(spark, grid + copies, 10, block=32)) > 100


def test_hard_negatives_at_the_ends(spark):
    big = [(i, [(-1.0) ** i * 10.0 ** (i % 30 * 10), 1.0, 10.0**i if i < 20 else 0.5], i % 2) for i in range(60)]
    check_negatives(spark, big, 5, block=16)
    assert not check_negatives(spark, [], 2)
    assert not check_negatives(spark, [(2, [1.0], 1)], 2)
    assert not check_negatives(spark, [(3, [1.0], 1), (5, [1.0], 1)], 2)
    assert not check_negatives(spark, [(2, [0.0, 0.0], 1), (4, [0.0, 0.0], 1)], 2)
    assert check_negatives(spark, [(2, [0.0], 1), (4, [0.0], 1), (5, [0.0], 2)], 2)
    assert check_negatives(spark, [(2, [], 1), (4, [], 1), (5, [], 2)], 2)  # empty vectors count as zeros


@pytest.mark.parametrize("seed", range(5))
def test_cover_tree_covers_and_separates(seed):
    r = np.random.default_rng(seed)
    points = r.normal(size=(300, [1, 2, 3, 8, 40][seed]))
    points[50:90] = points[0]
    tree = hard_negatives.Tree(points, leaf=8)
    assert sorted(tree.order) == list(range(300))
    for c, radius, first, last, low, high in zip(tree.centre, tree.radius, tree.first, tree.last, tree.low, tree.high):
        own = points[tree.order[first:last]]
        assert np.isclose(np.linalg.norm(own - points[c], axis=1).max(), radius)
        if high > low:  # children are the node's points, cut in their order
            assert tree.first[low] == first and tree.last[high - 1] == last and (tree.first[low + 1 : high] == tree.last[low : high - 1]).all()
    levels = hard_negatives.cover_levels(points, 8)
    root = np.linalg.norm(points - points[levels[0][0]], axis=1).max()
    for k, level in enumerate(levels):
        centres = np.unique(level)
        assert set(np.unique(levels[k - 1])) <= set(centres) or k == 0
        if len(centres) > 1:
            apart = np.linalg.norm(points[centres][:, None] - points[centres][None], axis=2)
            assert apart[~np.eye(len(centres), dtype=bool)].min() > root / hard_negatives.RATIO**k * (1 - 1e-9)


def test_descent_skips_nodes(spark):
    """In well separated groups only a small part of the points is scored."""
    r = np.random.default_rng(9)
    v = np.concatenate([r.normal(size=(256, 3)) * 0.1 + c for c in np.eye(3).repeat(2, axis=0) * np.array([[10.0], [-10.0]] * 3)])
    space = hard_negatives.Space(3, float(np.abs(v).max()), 2.0)
    tree = hard_negatives.Tree(space.augmented(v))
    arrays = {x: getattr(tree, x) for x in ("radius", "first", "last", "low", "high")} | {"centre": np.argsort(tree.order)[tree.centre]}
    arrays |= {"v": v[tree.order], "ids": tree.order, "labels": np.zeros(len(v), np.int64)}
    scored = []
    exact = hard_negatives.exact_scores
    try:
        hard_negatives.exact_scores = lambda q, c: (scored.append(len(c)), exact(q, c))[1]
        finds = hard_negatives.Finds(np.full((1, 1), -hard_negatives.END), np.full((1, 1), hard_negatives.END), 5)
        hard_negatives.descend(space, arrays, {"v": v[:1], "ids": np.array([0]), "labels": np.array([0])}, finds, slice(0, 1), True)
    finally:
        hard_negatives.exact_scores = exact
    assert len(finds.best[0]) == 5 and sum(scored) <= len(v) // 2
