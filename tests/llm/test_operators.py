"""Each operator against a brute-force twin or its library, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch
from tallyhouse.llm import byte_bpe, chat, components, decontaminate, line_dedup, mips, ngram_join, quality, secrets, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, body long, line int"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, repeats, and columns whose names the operators use inside."""
    long = prose(1, 4000)
    rows = [
        (1, "the cat sat on the mat\nthe cat sat on the mat", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (None, "the cat sat on the mat", "en", "a"),
        (4, " \n\t ", "en", "a"),
        (5, long, "en", "a"),
        (6, long, "en", "a"),
        (5, long, "en", "a"),
        (7, "x" * 20000, "en", "a"),
        (8, "漢字 тест \x00 😀 a b", None, "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.1, 7, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("common", [0, 5, 100_000])
def test_token_counts(spark, odd, none, common):
    library = piece_library()
    r = random.Random(8)
    loose = [(100 + k, "".join(r.choice("ab  \u2581\u2581 \n.é漢<s>\t\xa0xq1") for _ in range(r.choice([1, 2, 5, 60]))), *[None] * 6) for k in range(300)]
    rows = odd.unionByName(spark.createDataFrame(loose, DOCS))
    got = token_counts.token_counts(rows, PIECES, limit=100, common=common).collect()
    texts = Counter((r["doc_id"], len(library.encode(r["text"] or "")), len((r["text"] or "").encode())) for r in rows.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in got) == texts
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.token_counts(none, PIECES).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "\n a", "a \n  b ", "<s> hi </s>", "▁a ▁ b", "▁ ", "a▁  b", "▁", "漢字 テスト", "a" * 300, "a　 b"])
def test_pre_tokens_add_up(text):
    assert sum(token_counts.piece_counter(PIECES)(token_counts.pre_tokens(text))) == len(piece_library().encode(text))


def test_byte_bpe_matches_the_library(odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    for k in range(150):
        text = "".join(r.choice("ab aAth\n é漢!1.,'s") for _ in range(r.choice([3, 40, 900])))
        assert bpe.encode(text) == library.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()
    for n in (1, 2, 5, 30, 47, 48, 49, 60, 3000):  # both ways of merging, on both sides of where they change over
        for letters in ("ab", "aaaaab", "thequickbrown", "é漢а", "\x00\xff"):
            piece = "".join(r.choice(letters) for _ in range(n)).encode()
            want = library._encode_single_piece(piece)
            assert bpe.merge_queued(piece) == want or piece in bpe.ranks
            if len(piece) < 400:
                assert bpe.merge_listed(piece) == want or piece in bpe.ranks
    for row in byte_bpe.encoded(odd, RANKS).join(odd.dropDuplicates(["doc_id"]), "doc_id").collect():
        assert row["token_ids"] == library.encode_ordinary(row["text"] or "")
    back = byte_bpe.decoded(byte_bpe.encoded(odd, RANKS), RANKS)
    assert Counter(r["text"] for r in back.collect()) == Counter(r["text"] or "" for r in odd.collect())
    assert byte_bpe.digests(none, RANKS).count() == 0
    assert byte_bpe.digests(odd, RANKS).count() == odd.count()


def test_sharding(spark, odd, none):
    rows = sharding.shard_rows(odd, shards=3).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(odd.count()))
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["doc_id"], r["size"]) for r in rows} >= {(2, 16), (3, 16)}
    assert sharding.shard_rows(none).count() == 0
    again = sharding.shard_rows(odd.repartition(7), shards=3).collect()
    assert Counter(rows) == Counter(again)
    for n in (1, 2, 3, 17, 101, 1000, 5003):
        got = spark.range(n).select("id", sharding.permuted("id", n).alias("p")).select("id", "p", sharding.row_number_of("p", n).alias("back")).collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and all(r["id"] == r["back"] for r in got)


def brute_place(x, n, seed=7):
    """The network and the walk in plain Python, over Spark's hash."""
    from pyspark.sql import SparkSession

    a, b = sharding.grid(n)
    hashed = {}

    def spark_hash(r, j):
        if (r, j) not in hashed:
            row = SparkSession.active().sql(f"SELECT transform(sequence(0, {max(a, b)}), r -> xxhash64(r * 1L, {j}, {seed})) AS h").first()["h"]
            hashed.update({(k, j): h for k, h in enumerate(row)})
        return hashed[r, j]

    def network(x):
        left, right = x % a, x // a
        for j in range(sharding.ROUNDS):
            left, right = right, (left + spark_hash(right, j)) % (b if j % 2 else a)
        return right * a + left

    out = []
    for y in x:
        y = network(y)
        while y >= n:
            y = network(y)
        out.append(y)
    return out


@pytest.mark.parametrize("n", [1, 7, 101, 600])
def test_sharding_matches_brute_force(spark, n):
    docs = spark.createDataFrame([(k * 3, "x" * (k % 7)) for k in range(n)], "doc_id long, text string")
    rows = sorted(sharding.shard_rows(docs, shards=4).collect(), key=lambda r: r["row_number"])
    places = brute_place(range(n), n)
    assert [(r["shard"], r["slot"]) for r in rows] == [(p % 4, p // 4) for p in places]


def test_walks_are_bounded_and_equal_rows_spread(spark):
    for n in [*range(1, 3000), 10**6 + 3, 10**9 + 7, 10**10 + 19]:
        a, b = sharding.grid(n)
        assert 0 <= a * b - n <= sharding.WALK and a * b >= n
    same = spark.range(5000).selectExpr("1L AS doc_id", "'same' AS text")
    rows = sharding.shard_rows(same, shards=7).collect()
    slots = Counter(r["shard"] for r in rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5000 and max(slots.values()) - min(slots.values()) <= 1


def test_secrets(spark, odd, none):
    key = "zK8qLw3Vx9Tb2Rf7Hn5s4"
    rows = [(k, f"token = '{base64.b64encode(hashlib.sha1(str(k).encode()).digest()).decode()}' plainidentifiername anotherlongordinaryname2") for k in range(200)]
    rows += [(900, f"here {key} and secret: password=abcdef Password:'short' api-key=abcdefg AKIA{'A' * 16} akia {'0af' * 8}"), (901, None)]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[-2][1]
    assert ("markov", 5, 5 + len(key)) in found[900]
    assert [text[a:b] for k, a, b in found[900] if k == "assign"] == ["secret: password=abcdef"]
    assert [text[a:b] for k, a, b in found[900] if k == "access"] == ["AKIA" + "A" * 16]
    assert [text[a:b] for k, a, b in found[900] if k == "hex"] == ["0af" * 8]
    assert found[901] == [] and not any(k == "markov" for k, *_ in found[0])
    assert secrets.secret_spans(odd).count() == odd.count() and secrets.secret_spans(none).count() == 0


def test_secrets_of_letters_short_and_partly_covered(spark):
    rows = [(k, f"key {hashlib.sha1(str(k).encode()).hexdigest()} {random.Random(k).randrange(10**15, 10**16)} " + " ".join(f"{a}{b}" for a in ("ordinary", "another", "longer", "identifier") for b in ("name", "number", "_place", "ending"))) for k in range(100)]
    letters, short, rest = "qZvKxWjBfTgPzRkYhMcD", "zK8qLw3Vx9", "Qx7LbVz2KpWj"
    text = f"identifiername {letters} and {short} in {rest}{'0af' * 8}{rest} 4263429643439180 short {short[:9]}"
    got = secrets.secret_spans(spark.createDataFrame([*rows, (900, text)], "doc_id long, text string"))
    found = {r["doc_id"]: [(text[s["start"] : s["end"]]) for s in r["found"] if s["kind"] == "markov"] for r in got.where("doc_id in (1, 900)").collect()}
    assert found == {1: [], 900: [letters, short, rest, rest]}


def test_base_spans_are_the_patterns_own():
    import re

    given = [
        (0, re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
        (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    r, parts = random.Random(12), ["password", "API_KEY", "apikey", "toKen", "secret", "=", ": ", ":", " ", "\n", "'", '"', "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "é", "漢", "Z-_.+/=", "ſecret", "hunter22"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.choice([1, 3, 10, 40])))
        want = sorted((m.start(), k, m.end()) for k, pattern, fits in given for m in pattern.finditer(text) if fits(m))
        assert [x[:3] for x in secrets.base_spans(text)] == want, text


def test_secrets_held_out_recall_and_precision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratio = secrets.log_ratios(secrets.transition_counts(docs.where("doc_id % 2 = 0")))
    rows = [r["text"] or "" for r in docs.where("doc_id % 2 = 1").select("text").collect()]
    spans = [(t, secrets.base_spans(t)) for t in rows]
    words = {w for t, found in spans for _, _, w in secrets.other_words(t, found, whole=True) if secrets.ORDINARY(w)}
    r = random.Random(5)  # keys of alphabets that the patterns' hits may or may not come from, in words of 20 and more
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = {"base62": letters + letters.upper() + "0123456789", "letters": letters + letters.upper(), "base32": letters.upper() + "234567", "hex": "0123456789abcdef"}
    caught = {}
    for name, alphabet in alphabets.items():
        keys = {s[3] for _, found in spans for s in found if s[1] == 2} if name == "hex" else {"".join(r.choice(alphabet) for _ in range(r.randrange(20, 40))) for _ in range(500)}
        caught[name] = sum(secrets.is_random(w, ratio, 0.5) for w in keys) / len(keys)
    wrong = sum(secrets.is_random(w, ratio, 0.5) for w in words) / len(words)
    print("caught", caught, "of", len(words), "ordinary words wrong", wrong)
    assert min(caught.values()) >= 0.95 and len(words) > 500 and wrong <= 0.01


def test_many_matches_in_one_text_take_linear_time():
    import time

    text = "token=abcdefgh12 " * 60_000
    began = time.process_time()
    assert secrets.other_words(text, secrets.base_spans(text)) == []
    assert time.process_time() - began < 10


def test_repeated_labels_count_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = quality.fit(docs, labels, sample=10**6), quality.fit(docs, labels.unionByName(labels), sample=10**6)
    assert np.allclose(a["weights"], b["weights"]) and a["constant"] == b["constant"]


def test_quality(spark, odd, none, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("quality", "predicted").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.9
    rows = quality.scores(odd, model)
    assert rows.count() == odd.count() and rows.columns == [*[c for c in odd.columns if c != "score"], "score", "predicted"]
    assert all(0 <= r["score"] <= 1 for r in rows.collect())
    assert quality.scores(none, model).count() == 0
    assert quality.fit(odd, labels.limit(0))["constant"] == 0.5
    assert {r["score"] for r in quality.scores(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_quality_equals_a_plain_refit(spark):
    """The whole fit again in numpy, over the same rows: features, normal equations in one matrix, pooled shares."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    calibrates = (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0).alias("calibrates")
    known = docs.join(labels, "doc_id").where(~quality.held_out(F.col("doc_id"))).select("text", "quality", calibrates).collect()
    x, y = np.array([quality.statistics(r["text"]) for r in known]), np.array([float(r["quality"]) for r in known])
    apart = np.array([r["calibrates"] for r in known])
    draw = np.random.default_rng(11)
    waves = draw.normal(0, np.sqrt(2 * quality.GAMMA), (x.shape[1], quality.FEATURES))
    phases = draw.uniform(0, 2 * np.pi, quality.FEATURES)
    spread = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))

    def features(rows):
        z = np.clip((rows - x.mean(axis=0)) / spread, -8, 8) @ waves + phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / quality.FEATURES), np.ones((len(rows), 1))], axis=1)

    a = features(x[~apart])
    ridge = quality.RIDGE * max(1.0, len(a)) / (quality.FEATURES + 1 - 1)
    weights = np.linalg.lstsq(np.concatenate([a, np.sqrt(ridge) * np.eye(a.shape[1])]), np.concatenate([y[~apart], np.zeros(a.shape[1])]), rcond=None)[0]
    raw, own = np.round(features(x[apart]) @ weights, 9), y[apart]
    # The pooled share of a score: the largest, over starts at or below it, of the least mean up to an end at or above it.
    at = np.unique(raw)
    total, n = (np.array([0.0, *np.cumsum([f(own[raw == s]) for s in at])]) for f in (np.sum, len))
    share = [max(min((total[j] - total[i]) / (n[j] - n[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))]
    assert np.abs(model["weights"] - weights).max() < 1e-4 * max(1, np.abs(weights).max())
    # A knot is the mean score of the rows that share a value.
    count, share = np.diff(n), np.array(share)
    pools = np.split(np.arange(len(at)), np.flatnonzero(np.abs(np.diff(share)) > 1e-12) + 1)
    knots = [(at[k] @ count[k]) / count[k].sum() for k in pools]
    assert len(knots) == len(model["knots"])
    np.testing.assert_allclose(model["knots"], knots, atol=1e-6)
    np.testing.assert_allclose(model["shares"], [share[k[0]] for k in pools], atol=1e-9)
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, model).where("doc_id % 10 = 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 10 = 0").collect()}
    want = np.clip(np.interp(features(np.array([quality.statistics(texts[i] or "") for i in got])) @ weights, knots, [share[k[0]] for k in pools]), 0, 1)
    assert np.abs(np.array(list(got.values())) - want).max() < 1e-3


def test_isotonic_pools():
    knots, shares = quality.isotonic(np.array([1.0, 2.0, 3.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert list(shares) == sorted(shares) and shares[0] == 0 and shares[-1] == 1 and len(knots) == 3


def test_chat_round_trip(spark):
    marks = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<<SYS>>", "<|x|>", "", "a\\\\b", "[/INST"]
    for s in marks:
        shown = "\n".join(chat.render(role, s)[0] for role in ("system", "user", "assistant", "to|>ol"))
        assert [x[:2] for x in chat.parse(shown)] == [(role, s) for role in ("system", "user", "assistant", "to|>ol")]
    r = random.Random(5)
    rows = [(c, t, ("system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]), r.choice(marks) + prose(c * 100 + t, r.choice([1, 20, 150]))) for c in range(6) for t in range(r.choice([1, 2, 30]))]
    rows += [(50, 0, None, None), (50, 0, "user", "tie"), (50, 0, "user", "tie"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, window int")
    shown = chat.format_windows(df, RANKS, budget=300, history=60)
    count = chat.turn_counter(RANKS, public_tokenizers.PATTERN)
    for w in shown.collect():
        assert w["n_tokens"] <= 300 or w["n_new"] == 1
        assert w["n_tokens"] >= count(w["formatted"])
    back = {x["conv_id"]: x for x in chat.read_back(shown).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c))
        said = "".join(text for _, role, text in own if role == "assistant")
        assert back[c]["n_turns"] == len(own)
        assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (back[c]["loss_chars"], back[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert max(x["n_windows"] for x in back.values()) > 1
    assert chat.format_windows(df.limit(0), RANKS).count() == 0


def test_chat_of_one_very_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " + "x" * (t % 50)) for t in range(6000)] + [(2, 0, "assistant", "y" * 300_000)]
    shown = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), RANKS, budget=300, history=60)
    back = {x["conv_id"]: x for x in chat.read_back(shown).collect()}
    for c in (1, 2):
        own = [(role, text) for k, _, role, text in rows if k == c]
        said = "".join(text for role, text in own if role == "assistant")
        assert back[c]["n_turns"] == len(own) and back[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert back[1]["n_windows"] > 100 and back[2]["n_windows"] == 1


def test_top_k(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 8)) * r.uniform(0.1, 3, size=(400, 1))
    v[100:200] = v[0]  # ties
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(400)] + [(1000, None, 0), (1050, [1.0, None] * 4, 0), (1100, [float("nan")] * 8, 0), (1150, [float("inf")] * 8, 0), (1200, [0.0] * 8, 0), (1250, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")

    for lead, block in ((3, 64), (8, 4096)):
        got = sorted(map(tuple, mips.top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=5, lead=lead).collect()))
        q = {i: np.floor(256 * v[i]).astype(int) for i in range(400)} | {1200: np.zeros(8, int), 1250: np.zeros(8, int)}
        want = [(i, k + 1, j, s) for i in q if i % 50 == 0 for k, (s, j) in enumerate((-a, b) for a, b in sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5])]
        assert got == sorted(want)
    assert mips.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mips.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).count() == 2


def test_top_k_of_large_components(spark):
    rows = [(0, [1e8, 1.0]), (1, [3e8, -2.0]), (2, [-1e8, 5.0]), (50, [1e300, -1e300]), (51, [1e308, 1.0]), (52, [2e9, 1.0]), (53, [0.5, 0.25]), (54, [2e300, 1e300]), (100, [1.0, -1.0]), (101, [1.7e308, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    end = mips.END
    q = {i: [int(x) * 256 if abs(x) >= 2**53 else int(np.floor(x * 256)) for x in v] for i, v in rows}
    score = lambda a, b: max(-end, min(end, sum(x * y for x, y in zip(q[a], q[b]))))
    want = [(a, k + 1, b, -s) for a in (0, 50, 100) for k, (s, b) in enumerate(sorted((-score(a, b), b) for b in q if b != a)[:5])]
    assert want[10][2] == 50 and [x for x in want if x[0] == 100 and x[2] == 54][0][3] == end
    assert sorted(map(tuple, mips.top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


def brute_components(rows, n, num, den):
    sets = {i: set(ngram_join.shingle_set(t or "", n).tolist()) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, odd, none, n, num, den):
    r = random.Random(n)
    rows, k = [], 0
    for base in range(12):
        words = prose(base, r.choice([2, 12, 60, 300])).split()
        for copy in range(8):
            own = list(words)
            for _ in range(r.choice([0, 1, 2, 4]) * len(own) // 60):
                own[r.randrange(len(own))] = f"n{r.random()}"
            if copy == 3:
                words = own  # chains
            rows.append((k, " ".join(own).upper() if copy == 5 else " ".join(own)))
            k += 1
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(rows, n, num, den)
    got = ngram_join.linked(odd, n, num, den).collect()
    assert len(got) == odd.count()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8)}
    assert ngram_join.linked(none).count() == 0


def test_ngram_join_of_ids_with_several_texts(spark):
    a, b = prose(1, 90), prose(2, 90)
    near = lambda text: text.rsplit(" ", 1)[0]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (5, prose(3, 90)), (6, prose(4, 90)), (6, prose(3, 90)), (7, prose(4, 90)), (7, "")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {(x["doc_id"], x["component_id"]) for x in ngram_join.linked(df).where("n_shingles > 0").collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5)}


def test_texts_with_many_empty_segments_have_no_key_in_common():
    bands = ngram_join.Bands(4, 5)
    r = np.random.default_rng(0)
    seen: Counter = Counter()
    for size in [*range(3, 60), *range(60, 6000, 60)]:
        for _ in range(3):
            seen.update(ngram_join.segment_keys(r.integers(0, 1 << 63, size).astype(np.uint64), bands).tolist())
    assert max(seen.values()) == 1


def test_sketches_bound_the_difference():
    r = random.Random(9)
    for _ in range(50):
        words = prose(r.random(), r.choice([20, 200, 1500])).split()
        other = [w if r.random() > 0.03 else "new" for w in words]
        a, b = ngram_join.shingle_set(" ".join(words), 3), ngram_join.shingle_set(" ".join(other), 3)
        apart = len(np.setxor1d(a, b))
        assert ngram_join.hamming(*map(ngram_join.dense_sketch, (a, b))) <= apart
        short = [ngram_join.folded(ngram_join.dense_sketch(s), ngram_join.SHORT) for s in (a, b)]
        assert ngram_join.hamming(*short) <= ngram_join.hamming(*map(ngram_join.dense_sketch, (a, b)))
        bands = ngram_join.Bands(4, 5)
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) and len(a):
            assert apart == 0 or set(ngram_join.segment_keys(a, bands)) & set(ngram_join.segment_keys(b, bands))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(60, 50), (50, 70), (80, 80)]
    ids = spark.createDataFrame([(i, i) for i in range(100)], "id long, comp long")
    got = {r["id"]: r["comp"] for r in components.merged(Scratch(spark), ids, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i in (60, 50, 70) else i for i in range(100)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark, odd, none):
    r = random.Random(4)
    bases = [prose(k, r.choice([3, 8, 9, 15, 16, 17, 40])).split() for k in range(20)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(words))
                words[at : at + r.choice([0, 1])] = r.choice([[], ["new"], [f"n{r.randrange(3)}"]])
            lines.append("  ".join(words) if r.random() < 0.1 else " ".join(words))
        rows.append((i, "\n".join([*lines, ""])))
    want, seen = {}, []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = line.split()
            close = words and any(words == x or (min(len(words), len(x)) >= 8 and distance(words, x) <= 1) for x in seen)
            if words:
                seen.append(words)
            if not close:
                kept.append(line)
        want[i] = "\n".join(kept)
    got = {x["doc_id"]: x["text"] for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    out = line_dedup.deduplicated(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count()
    kept = {(x["doc_id"], x["n_removed"]) for x in out.collect()}
    assert kept == {(1, 1), (2, 0), (3, 0), (None, 0), (4, 0), (5, 0), (6, 1), (7, 0), (8, 0)}
    assert line_dedup.deduplicated(none).count() == 0


def test_short_lines_one_word_apart(spark, tmp_path):
    r = random.Random(6)
    bases = [prose(k, r.choice([1, 2, 3, 4, 5, 6, 7, 8]), 12).split() for k in range(30)]
    rows = [(900, "Tolyoued with by of nteres atre are."), (901, "Anat with by of nteres atre are.")]
    for i in range(80):
        words = list(r.choice(bases))
        at = r.randrange(len(words))
        words[at : at + r.choice([0, 1])] = r.choice([[], [f"n{r.randrange(3)}"]])
        rows.append((i, " ".join(words)))
    want, seen = {}, []
    for i, line in sorted(rows):
        words = line.split()
        gone = words and any(words == x or (min(len(words), len(x)) >= 4 and distance(words, x) <= 1) for x in seen)
        seen += [words] * bool(words)
        want[i] = int(bool(gone))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x["n_removed"] for x in line_dedup.op7(spark, str(tmp_path)).collect()}
    assert got == want and got[901] == 1


def test_within_one():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("ab") for _ in range(r.randrange(6))] for _ in range(2))
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


def test_decontamination(spark, odd, none):
    items = [(k, f"{prose(1000 + k, 18).capitalize()}? {prose(2000 + k, 6)}.") for k in range(80)] + [(98, ""), (99, None)]
    held = {3: [5], 4: [6, 7], 9: [70]}
    docs = [(i, prose(i, 500, 3000) + " " + " ".join(items[k][1] for k in held.get(i, [])).upper() + " " + prose(-i - 1, 300, 3000)) for i in range(12)]
    docs += [(50, items[8][1].split("?")[0]), (51, items[8][1].replace(items[8][1].split()[4], "changed")), (52, None), (53, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, ks in held.items() for k in ks} | {(51, 8)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.uncontaminated(df, bench).collect()} == {i for i, _ in docs} - {3, 4, 9, 51}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.uncontaminated(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_does_not_depend_on_other_items_or_shards(spark, monkeypatch):
    items = [(k, f"{prose(1000 + k, 16).capitalize()}? {prose(2000 + k, 4)}.") for k in range(30)]
    words = items[7][1].replace("?", "").replace(".", "").lower().split()
    spread = " ".join(f"{w} {prose(k, 60)}" for k, w in enumerate(words))  # in order, over 1,200 words
    docs = spark.createDataFrame([(1, spread), (2, f"{prose(-1, 300)} {' '.join(words)} {prose(-2, 300)}")], "doc_id long, text string")
    long = (99, prose(77, 3000, 2000))
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    found = lambda rows: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.contaminated(docs, bench(rows)).collect())
    assert [x[:2] for x in found([*items, long])] == [(2, 7)]
    held = spark.createDataFrame([(3, f"{prose(-3, 100)} {long[1]}")], "doc_id long, text string")
    assert [r["item_id"] for r in decontaminate.contaminated(held, bench([*items, long])).collect()] == [99]
    partly = [(k, f"common{k % 3} words{k % 2} {text}") for k, text in items]
    whole = found(partly)
    kept = lambda: sorted(r["doc_id"] for r in decontaminate.uncontaminated(docs, bench(partly)).collect())
    one = kept()
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 600)
    assert whole and whole == found(partly) and one == kept()


def test_decontamination_of_repeats_and_very_long_items(spark, monkeypatch):
    long = prose(5, 9000, 3000)
    items = [(1, f"{prose(1, 30)}. {prose(2, 8)}."), (1, f"{prose(1, 30)}. {prose(2, 8)}."), (2, f"{prose(1, 30)}. {prose(2, 8)}."), (3, long)]
    text = f"{prose(9, 100)} {items[0][1]} {prose(8, 50)}"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, long), (3, None), (None, ""), (4, prose(77, 200))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 500):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
        assert got == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (2, 3): 1}
        assert sorted(str(r["doc_id"]) for r in decontaminate.uncontaminated(docs, bench).collect()) == ["3", "4", "None"]


def test_wand_finds_what_full_scoring_finds():
    r = random.Random(2)
    index = decontaminate.Index([(k, prose(r.randrange(5), 30, 60)) for k in range(150)])
    for k in range(60):
        words = set(prose(k % 5, 40, 60).split())
        full = Counter()
        for w in words:
            for item, x in zip(*index.postings.get(w, ([], []))):
                full[item] += x
        for bound in (0.2, 0.5, 0.8):
            assert {i for i, x in full.items() if x >= bound} == {i for i, _ in index.retrieve(words, bound)}


def test_repeated_items_count_by_the_larger_score():
    """Two texts of one id, one of them wholly in the passage: its score is the item's, whichever row comes last."""
    whole = "what is the capital of the old river province answer the town of three bridges"
    part = "what is the capital of the old river province answer the town of three bridges and seven further towers"
    text = f"some words before {whole} and some words after it"
    alone = decontaminate.Banded([(1, whole)], known=None).search(text, 0.3, 0.3)[1]
    for items in ([(1, whole), (1, part)], [(1, part), (1, whole)]):
        index = decontaminate.Index(items, 0.3, None)
        both = index.search(decontaminate.words_of(text), 0.3, 0.3)
        each = [decontaminate.Index([(k, x[1]) for k, x in enumerate(items)], 0.3, None).search(decontaminate.words_of(text), 0.3, 0.3)]
        assert both[1] == max(each[0].values()) and set(both) == {1}
    assert alone[0] > 0.9
