"""Each operator against a brute-force version on a small corpus, and on odd input."""

import hashlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import bpe, fingerprints, line_dedup, linking, mixing, order_minhash, quality, queries, suffix_dedup, textvec, token_histogram, training_order, warc_revisit

PATH, PATTERN = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", len(t or "")) for d, t, s in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_fingerprints(docs, rows):
    pairs = [(d, t) for d, t, _ in rows]
    edits, out = brute.edited(pairs), {r.doc_id: r for r in fingerprints.edit_fingerprints(docs).collect()}
    assert len(out) == len(rows)
    by_text, order = {}, sorted(out, reverse=True)
    for d, t in pairs:
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(t or ""), hashlib.sha256(edits[d].encode()).hexdigest())
        assert by_text.setdefault(t or "", r.fingerprint) == r.fingerprint
        a, b = ({s for s, _ in brute.kmers(x)} for x in (t, edits[d]))
        if a and b:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2
    for d, e in zip(order, order[1:] + order[:1]):
        x, y = (np.frombuffer(bytes.fromhex(out[k].fingerprint), ">u2") for k in (d, e))
        assert out[d].near_next == (x == y).mean()


def test_fingerprint_classes(docs, rows):
    out = fingerprints.near_classes(docs).collect()
    got = {r.doc_id: r.class_id for r in out}
    assert got == brute.classes([(d, t) for d, t, _ in rows], ordered=False) and len(set(got.values())) < len(got) - 10
    assert {r.doc_id: r.class_size for r in out} == {d: Counter(got.values())[c] for d, c in got.items()}


def _chains() -> list[str]:
    """Texts alike to some of those they share bands with, but not to others, whose least text_id heads the bands."""
    texts = []
    for k in range(60):
        w = [f"w{k}_{i}" for i in range(104)]
        texts += [" ".join(w), " ".join(w[:-5] + [f"x{i}" for i in range(5)]), " ".join([f"y{i}" for i in range(11)] + w[11:]), " ".join(w[7:] + [f"z{i}" for i in range(7)])]
    return texts


@pytest.mark.parametrize("ordered", [False, True])
def test_classes_miss_no_link(spark, rows, ordered):
    """All pairs of similarity 0.8, among them those whose buckets are headed by a third text that is like neither."""
    texts = list(enumerate([t for _, t, _ in rows] + _chains()))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = (order_minhash.near_duplicates if ordered else fingerprints.near_classes)(df).collect()
    assert {r.doc_id: r.class_id for r in out} == brute.classes(texts, ordered=ordered)


def _frames() -> list[tuple[int, str]]:
    """A long frame that many texts share, with insides that are alike in twos and threes or not at all."""
    import random

    r, frame = random.Random(8), [f"f{i}" for i in range(60)]
    texts = []
    for k in range(40):
        inside = [f"i{k}_{i}" for i in range(40)]
        for copy in range(k % 3 + 1):
            own = list(inside)
            for i in r.sample(range(40), copy):
                own[i] = f"o{k}_{copy}_{i}"
            texts.append(" ".join(frame + own))
    return list(enumerate(texts))


@pytest.mark.parametrize("small, block", [(16, 6 << 20), (1, 6 << 20), (1, 3000), (100, 1)])
@pytest.mark.parametrize("ordered", [False, True])
def test_classes_within_large_buckets(spark, monkeypatch, ordered, small, block):
    """Buckets of many classes, whichever way they are worked on."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "BATCH", 3)
    texts = _frames()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = (order_minhash.near_duplicates if ordered else fingerprints.near_classes)(df).collect()
    want = brute.classes(texts, ordered=ordered)
    assert {r.doc_id: r.class_id for r in out} == want and 20 < len(set(want.values())) < len(texts) - 10


@pytest.mark.parametrize("small, block", [(16, 6 << 20), (16, 3000), (1, 3000), (1, 1)])
def test_classes_of_texts_that_share_one_bucket_only(spark, monkeypatch, small, block):
    """However large a bucket is, two alike texts in it are linked with no second bucket that both are in."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", block)
    docs = _frames()
    texts = spark.createDataFrame([(b"%04d" % d, len(t), [7]) for d, t in docs], "id binary, size long, buckets array<long>")
    bodies = spark.createDataFrame([(b"%04d" % d, t) for d, t in docs], "id binary, text string")
    like = linking.Likeness(order_minhash._prepared, order_minhash.alignment, order_minhash.LEAST)
    roots = {int(r.id): int(r.root) for r in linking.linked_classes(texts, bodies, like, "one").collect()}
    assert {d: roots.get(d, d) for d, _ in docs} == brute.classes(docs)


def test_suffix_dedup(docs, rows):
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute.repeats([(d, t) for d, t, _ in rows]) and sum(r[2] for r in got) > 3000


def test_suffix_dedup_of_hot_anchors(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute.repeats([(d, t) for d, t, _ in rows])


@pytest.mark.parametrize("hot", [1, 5, 50])
def test_suffix_dedup_of_one_anchor_in_many_segments(spark, monkeypatch, hot):
    """A passage of 300 bytes in 80 texts: with what is around it, some strings of 400 bytes are equal by what stands before, some by what follows."""
    import random

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r, middle = random.Random(3), "".join(random.Random(4).choice("abcdefgh") for _ in range(300))
    say = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    before, after = [say(150) for _ in range(4)], [say(150) for _ in range(4)]
    texts = [say(r.randrange(200)) + r.choice([say(150), *before, before[0][-60:], before[1][-99:]]) + middle + r.choice([say(150), *after, after[0][:41], after[1][:99]]) + say(r.randrange(200)) for _ in range(80)]
    docs = list(enumerate(texts))
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    assert got == brute.repeats(docs) and sum(x[2] for x in got) > 5000


def test_suffix_dedup_of_long_texts(spark):
    """Texts of several pieces of a mebibyte, equal in stretches that cross the pieces' ends; checked on the bytes."""
    rng = np.random.default_rng(6)
    own = [bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)) for _ in range(2)]
    shared = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    texts = [own[0][:1_046_000] + shared + own[0][1_046_000:], shared[:399] + own[1][:1_048_000] + shared[1000:] + own[1][1_048_000:] + shared[100:499]]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string"), with_bytes=True).collect()}
    assert got[0] == (4000, 1, texts[0].replace(shared[1000:], b""))
    assert got[1] == (4000, 1, texts[1].replace(shared[1000:], b""))
    again = suffix_dedup.remove_repeats(spark.createDataFrame([(0, texts[0].decode()), (1, shared[100:500].decode())], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in again) == [(0, 400), (1, 400)]


def test_suffix_dedup_in_pieces(docs, rows, monkeypatch):
    out = []
    for start in range(0, 600, 100):
        data = (rows[3][1] * 3).encode()[start : start + 100 + 399]
        out.append(len(suffix_dedup.segments(np.frombuffer(data, np.uint8))[0]))
    assert all(out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=9), min_size=1, max_size=4))
def test_suffix_sort(groups):
    flat = [s for g in groups for s in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    data, at, size = suffix_dedup._joined(flat)
    order, common = suffix_dedup.sort_suffixes(data, at, size, group)
    want = sorted(range(len(flat)), key=lambda k: (group[k], flat[k], k))
    assert [(group[k], flat[k]) for k in order] == [(group[k], flat[k]) for k in want]
    for i in range(1, len(order)):
        a, b = flat[order[i - 1]], flat[order[i]]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[i] == (n if group[order[i]] == group[order[i - 1]] else 0)


def test_suffix_sort_after_hash_collision(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "common", lambda sums, p, q, most: most)
    data, at, size = suffix_dedup._joined([b"bb", b"ab", b"ba"])
    assert suffix_dedup.sort_suffixes(data, at, size, np.zeros(3, np.int64))[0].tolist() == [1, 2, 0]


def test_warc_revisits(spark):
    records = spark.createDataFrame(
        [
            (1, "http://www.A.org/x/?utm_source=f#top", 10, 200, '"e1"', 5, {"content-type": "text/html", "server": "s"}, "one"),
            (2, "https://a.org/x", 20, 200, '"e2"', 6, {"content-type": "text/html"}, "two"),
            (3, "https://a.org/x", 15, 304, 'W/"e1"', None, {"server": "t", "content-type": "no"}, None),
            (4, "https://a.org/x", 25, 304, '"e1"', None, {}, None), (5, "https://a.org/x", 26, 304, None, 6, {}, None), (6, "https://a.org/x", 27, 304, None, None, None, None),
            (7, "https://a.org/x", 9, 304, '"e1"', None, {}, None), (8, None, 9, 304, None, None, {}, None), (9, "https://a.org/x", None, 304, None, None, {}, None), (6, "https://a.org/x", 27, 304, None, None, None, None),
        ], "record_id long, url string, ts long, status int, etag string, last_modified long, headers map<string,string>, body string")
    out = sorted((r.record_id, r.outcome, r.refers_to, r.header_line) for r in warc_revisit.resolve_revisits(records).collect())
    assert out == [
        (3, "resolved", 1, "content-type: text/html\nserver: t"), (4, "changed", None, None), (5, "resolved", 2, "content-type: text/html"), (6, "resolved", 2, "content-type: text/html"),
        (6, "resolved", 2, "content-type: text/html"), (7, "missing", None, None), (8, "missing", None, None), (9, "missing", None, None),
    ]
    assert {(r.record_id, r.body) for r in warc_revisit.resolve_revisits(records, with_body=True).where("record_id = 5").collect()} == {(5, "two")}
    assert warc_revisit.resolve_revisits(records.limit(0)).count() == 0


def test_as_of_over_many_blocks(spark):
    data = [(k, t, (t * 7 + k) % 3 == 0) for k in range(3) for t in range(0, 200, 2)]
    df = spark.createDataFrame(data, "k int, ts long, good boolean")
    got = {(r.k, r.ts): r.found for r in warc_revisit.as_of(df, ["k"], "ts", "ts", F.col("ts"), F.col("good"), blocks=16).collect()}
    assert got == {(k, t): max((u for j, u, g in data if g and j == k and u < t), default=None) for k, t, _ in data}


def test_line_dedup(docs, rows):
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup_lines(docs).collect()}
    want = brute.line_runs([(d, t) for d, t, _ in rows])
    assert got == want and sum(n for _, n in got.values()) > 50


def test_line_dedup_of_long_passages_of_two_lines(spark):
    """Repeated stretches of 50 words go however their words are spread over one or two lines; those of 49 stay."""
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    docs, want = [], []
    for at, (x, y) in enumerate([(23, 46), (25, 25), (49, 1), (1, 49), (5, 60), (60, 5), (60, 60), (25, 24), (1, 48)]):
        passage = [say(f"x{at}_", x), say(f"y{at}_", y)]
        docs += [(2 * at, "\n".join([f"one {at}", *passage, f"two {at}"])), (2 * at + 1, "\n".join([f"three {at}", passage[0], "", "  " + passage[1], f"four {at}"]))]
        want.append((2 * at, 0))
        want.append((2 * at + 1, 2 if x + y >= 50 else 0))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sorted((d, r.n_deleted) for d, r in out.items()) == want
    assert out[1].text == "three 0\n\nfour 0" and out[15].text == docs[15][1]


def test_line_dedup_query_says_what_its_sql_says_of_two_lines(spark, tmp_path):
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    texts = [f"{k}\n{say('x', 23)}\n{say('y', 46)}\n{k} end\n{say('z', 50)}\n{k} last" for k in range(3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT doc_id, text, n_lines, n_deleted FROM ({queries.ORACLE_SQL['op4_line_dedup']})").fetchall()
    got = queries.op4_line_dedup(spark, str(tmp_path)).select("doc_id", "text", "n_lines", "n_deleted").collect()
    assert sorted(map(tuple, got)) == sorted(want) and [n for *_, n in sorted(want)] == [0, 1, 1]


def test_winnowing_selects_few_lines_and_the_same_of_equal_runs():
    """About 2 of 4 lines for runs of 3, as winnowing promises; wherever a run stands, it selects the same line of its own."""
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    hashes[2000:2040] = hashes[100:140]
    first = np.arange(3998)
    at, runs = line_dedup.selected(hashes, first, np.full(3998, 3), 3)
    assert 0.45 < len(at) / 4000 < 0.55 and sum(bin(x).count("1") for x in runs.tolist()) == 3998
    inside = lambda a: {p - a: r for p, r in zip(at.tolist(), runs.tolist()) if a + 2 <= p < a + 38}
    assert inside(100) == inside(2000)


@pytest.mark.parametrize("run, long", [(1, 50), (2, 9), (4, 12), (7, 1000)])
def test_line_dedup_of_other_runs(spark, run, long):
    """Against all runs of `run` lines, one by one."""
    import random

    r = random.Random(run)
    docs = [(d, "\n".join(r.choice("abcdef") for _ in range(r.randint(0, 40)))) for d in range(30)]
    got = {x.doc_id: (x.text, x.n_deleted) for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run, long).collect()}
    assert got == brute.line_runs(docs, run, long)


def test_token_histogram(docs, rows, library):
    lengths = [len(library.encode_ordinary(t or "")) for _, t, _ in rows]
    out = {r.context_limit: r for r in token_histogram.length_histogram(token_histogram.token_lengths(docs, PATH, PATTERN), block=64).collect()}
    assert {k: r.n_docs for k, r in out.items()} == Counter(lengths)
    for k, r in out.items():
        assert (r.docs_upto, r.tokens_upto, r.truncated_tokens) == (sum(n <= k for n in lengths), sum(n for n in lengths if n <= k), sum(min(n, k) for n in lengths))


def test_histogram_answers_any_limit(spark):
    lengths = [0, 3, 3, 10, 2000]
    h = token_histogram.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    limits = [5, 0, 3000, 3, 1999, 5, None, -1]
    out = token_histogram.answer(h, spark.createDataFrame([(n,) for n in limits], "context_limit long")).collect()
    assert sorted(r.context_limit for r in out) == [-1, 0, 3, 5, 1999, 3000]
    for r in out:
        fit = [n for n in lengths if n <= r.context_limit]
        assert (r.docs_upto, r.docs_over, r.tokens_upto) == (len(fit), 5 - len(fit), sum(fit))
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths)
    shares = {r.share: r.length for r in token_histogram.lengths_at(h, (0.2, 0.21, 0.6, 0.8, 0.81, 1.0)).collect()}
    assert shares == {0.2: 0, 0.21: 3, 0.6: 3, 0.8: 10, 0.81: 2000, 1.0: 2000}


def test_histogram_of_odd_lengths(spark):
    """Null counts as 0 tokens, other columns are not read, no rows give no row and answers of 0."""
    df = spark.createDataFrame([(None, "x"), (0, "x"), (4, None)], "n_tokens long, block string").withColumns({c: F.lit("x") for c in CLASHING})
    assert [(r.context_limit, r.n_docs) for r in token_histogram.length_histogram(df).orderBy("context_limit").collect()] == [(0, 2), (4, 1)]
    none = token_histogram.length_histogram(df.limit(0))
    assert none.count() == 0
    assert [tuple(r) for r in token_histogram.answer(none, spark.createDataFrame([(7,)], "context_limit long")).collect()] == [(7, 0, 0, 0, 0)]
    assert [r.length for r in token_histogram.lengths_at(none, (0.5,)).collect()] == [None]


def test_revisits_of_odd_records(spark):
    """Nulls in any column, repeated records, no records, and columns named as the operator's own."""
    kind = "record_id long, url string, ts long, status int, etag string, last_modified long, headers map<string,string>, body string"
    rows = [(None,) * 8, (1, None, 1, 304, None, None, None, None), (2, "http://a/", None, 304, None, None, None, None), (3, "http://a/", 5, 200, None, None, None, None), (3, "http://a/", 5, 200, None, None, None, None)]
    rows += [(4, "http://a", 9, 304, None, None, None, None)] * 2 + [(5, "", 9, 304, '"x"', 3, {"age": None}, "b" * 300_000), (6, "http://a", 9, None, None, None, {}, "")]
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in (*CLASHING, "canonical", "found", "_block", "_latest", "_within", "digest", "outcome")})
    got = sorted((r.record_id, r.outcome, r.refers_to) for r in warc_revisit.resolve_revisits(df).collect())
    assert got == [(1, "missing", None), (2, "missing", None), (4, "resolved", 3), (4, "resolved", 3), (5, "missing", None)]
    assert warc_revisit.resolve_revisits(df.limit(0)).count() == 0


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == brute.classes([(d, t) for d, t, _ in rows])
    assert len(set(got.values())) < len(got) - 10


def test_near_duplicates_of_short_texts(spark):
    """Texts of few words and the same with one word more at an end, or within words that repeat, are of one class."""
    texts = []
    for n in (8, 9):
        for k in range(60):
            base = [f"w{n}_{k}_{i}" for i in range(n)]
            texts += [" ".join(base), " ".join([*base, "more"]) if k % 2 else " ".join(["more", *base])]
    texts += ["same " * 8, "same " * 9, "other " * 9, "other " * 10]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute.classes(list(enumerate(texts))) == {d: d // 2 * 2 for d in range(len(texts))}


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    for name, value in (("BLOCK", 800), ("SMALL", 2), ("BATCH", 2)):
        monkeypatch.setattr(linking, name, value)
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == brute.classes([(d, t) for d, t, _ in rows])


def test_alignment_is_sensitive_to_order():
    x = np.arange(1, 200, dtype=np.uint64)
    assert order_minhash.alignment(x, x) == 1.0
    assert order_minhash.alignment(x, np.concatenate([x[100:], x[:100]])) == 0.0
    y = np.concatenate([x[:20], x[30:]])
    assert order_minhash.alignment(x, y) == pytest.approx(len(y) / len(x))


def test_quality(docs, rows):
    out = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    for d, t, _ in rows:
        r = out[d]
        want = brute.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    assert all(out[d].kept for d in range(40))


def test_quality_lines():
    rules = quality.QualityRules()
    assert quality.line_fails("Home | About | Contact", rules) and quality.line_fails("Click here for more.", rules) and quality.line_fails("two words", rules)
    assert not quality.line_fails("This is a plain sentence about a cat.", rules) and not quality.line_fails("Yes!", rules)
    assert quality.clean_lines("A fine sentence stands here.\nHome | About | More\n", rules)[0] == "A fine sentence stands here.\n"


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, out = {s: weights[i % len(weights)] for i, s in enumerate(names)}, float(sum(sizes.values())), {}
    free = set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * level > most * sizes[s] + 1e-9}
        if not capped:
            return out | {s: weight[s] * level for s in free}
        for s in capped:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= capped
    return out


def test_mixing(docs, rows):
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in size:
        sizes[source[d]] += size[d]
    want, out = _targets(sizes), mixing.mix_sources(docs).collect()
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    assert {r.doc_id: r.taken for r in out} == brute.taken(rows, want)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()))


def test_mixing_in_few_tasks(docs, rows, monkeypatch):
    """The schedule is the same whatever the tasks that make it."""
    whole = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "SLOTS", 64)
    monkeypatch.setattr(mixing, "TASKS", 3)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == whole


def test_mixing_order_whatever_the_ranges(docs, monkeypatch):
    """Parts of the shuffled order that are cut into 64 or more ranges give the same as whole ones."""
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    whole = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE", 1)
    assert docs.count() > 32 and sorted(map(tuple, mixing.mix_sources(docs).collect())) == whole


def test_mixing_reshares_what_small_sources_cannot_give(spark):
    df = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (500, "b"), (300, "c"), (0, "d")])], "doc_id long, text string, source string")
    out = {r.doc_id: r.target for r in mixing.mix_sources(df).collect()}
    want = _targets({"a": 10, "b": 500, "c": 300, "d": 0})
    assert out == pytest.approx({0: want["a"], 1: want["b"], 2: want["c"], 3: 0.0}) and out[0] == 30.0


def test_mixing_of_sources_far_below_the_total(spark):
    """30 million words of one source beside sources of less than a 2^20th of them."""
    small = {f"s{k:02}": n for k, n in enumerate([1, 2, 5, 10, 20, 28, 29, 30, 50, 100, 300])}
    big = spark.range(30).select("id", F.expr("repeat('w ', 1000000)").alias("text"), F.lit("big").alias("source"))
    few = spark.createDataFrame([(100 + i, "w " * n, s) for i, (s, n) in enumerate(small.items())], "id long, text string, source string")
    out = {r.source: (r.target, r.taken, r.words) for r in mixing.mix_sources(big.unionByName(few).withColumnRenamed("id", "doc_id"), keep=("source",)).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("size").alias("words")).collect()}
    assert {s: w for s, (_, _, w) in out.items()} == small | {"big": 30_000_000}
    for s, (target, taken, _) in out.items():
        assert target == pytest.approx(_targets(small | {"big": 30_000_000})[s]) and abs(taken - target) <= 5
    assert out["s08"][0] == 150.0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    assert sorted(training_order.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_training_order(docs, rows, spark, tmp_path):
    ordered = training_order.training_order(docs, length=64, shard_rows=16)
    out = sorted(ordered.collect(), key=lambda r: r.slot)
    assert [r.slot for r in out] == list(range(len(out)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 129 and len(r.record) == 128 for r in out)
    by = defaultdict(dict)
    for r in out:
        by[r.doc_id][r.seq_no] = np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens]
    for d, t, _ in rows:
        assert np.concatenate([by[d][k] for k in range(len(by[d]))]).tolist() == [*(t or "").encode(), 256]
    assert [r.doc_id for r in out] != sorted(r.doc_id for r in out)


def test_shards(spark, tmp_path):
    """Bytes of every value, line ends among them, come back from the files, by Spark or by plain seeks; from any slot on."""
    df = spark.createDataFrame([(d, "".join(map(chr, range(d, 90 + 31 * d)))) for d in range(40)], "doc_id long, text string")
    ordered, path = training_order.training_order(df, length=64, shard_rows=16), tmp_path / "shards"
    training_order.write_shards(ordered, str(path))
    want = {r.slot: (r.shard, r.byte_offset, bytes(r.record)) for r in ordered.collect()}
    files = {int(d.name.split("=")[1]): [f for f in d.iterdir() if f.name.startswith("part")] for d in path.glob("shard=*")}
    assert sorted(files) == list(range(-(-len(want) // 16))) and all(len(f) == 1 for f in files.values())
    for shard, at, record in want.values():
        assert files[shard][0].read_bytes()[at : at + 128] == record
    for slot in (0, 1, 16, 37, len(want) - 1, len(want), len(want) + 99):
        got = [(r.slot, bytes(r.record)) for r in training_order.read_from(spark, str(path), slot, 64, 16).collect()]
        assert got == [(k, want[k][2]) for k in range(slot, len(want))]
    training_order.write_shards(training_order.training_order(df.limit(0)), str(tmp_path / "none"))
    assert training_order.read_from(spark, str(tmp_path / "none"), 0).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_training_order_of_token_ids(docs, rows, library, width):
    encoded = bpe.encode_documents(docs, PATH, PATTERN).withColumn("text", F.lit("x"))
    out = training_order.training_order(encoded, length=32, shard_rows=16, ids="ids", width=width, end=50256, pad=50257).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    by = defaultdict(dict)
    for r in out:
        ids = np.frombuffer(bytes(r.record), f"<u{width}")
        assert len(ids) == 32 and (ids[r.n_tokens :] == 50257).all()
        by[r.doc_id][r.seq_no] = ids[: r.n_tokens]
    for d, t, _ in rows:
        assert np.concatenate([by[d][k] for k in range(len(by[d]))]).tolist() == [*library.encode_ordinary(t or ""), 50256]


def _streams(sequences) -> dict:
    """part to all ids of its sequences, end to end, without what fills them up."""
    by = defaultdict(dict)
    for r in sequences:
        by[r.part][r.number] = np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens]
    return {p: np.concatenate([x[k] for k in range(len(x))]).tolist() for p, x in by.items()}


@pytest.mark.parametrize("length", [7, 32, 1024])
def test_packed_sequences(docs, rows, library, length):
    """All documents' ids, end to end within a partition; each sequence knows where in which document it begins."""
    want = {d: [*library.encode_ordinary(t or ""), 50256] for d, t, _ in rows}
    out = training_order.pack_sequences(docs, PATH, PATTERN, 50256, 50257, length).collect()
    left = dict(want)
    for ids in _streams(out).values():
        at = 0
        while at < len(ids):
            d = next(d for d, x in left.items() if ids[at : at + len(x)] == x)
            at += len(left.pop(d))
    assert not left
    for r in out:
        ids = np.frombuffer(bytes(r.record), "<u2").tolist()
        assert len(ids) == length and set(ids[r.n_tokens :]) <= {50257}
        assert ids[: r.n_tokens][: len(want[r.doc_id]) - r.begin] == want[r.doc_id][r.begin :][: r.n_tokens]
    assert sum(r.n_tokens < length for r in out) <= docs.rdd.getNumPartitions()


def test_packed_sequences_of_odd_texts(spark):
    df = spark.createDataFrame([(*r, "en", 1) for r in ODD], SCHEMA).withColumns({c: F.lit("x") for c in (*CLASHING, "record", "part", "number", "begin")})
    packed = training_order.pack_sequences(df, PATH, PATTERN, 50256, 50257)
    assert sum(x.count(50256) for x in _streams(packed.collect()).values()) == len(ODD)
    none = training_order.pack_sequences(df.limit(0), PATH, PATTERN, 50256, 50257)
    assert none.count() == 0 and training_order.slot_sequences(none).count() == 0
    with pytest.raises(Exception, match="don't fit"):
        training_order.pack_sequences(df, PATH, PATTERN, 1 << 16, 3).count()


def test_training_order_query_writes_shards_of_token_ids(spark, docs, rows, library, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    monkeypatch.setattr(training_order, "write_shards", lambda ordered, path, f=training_order.write_shards: (f(ordered, path), written.append(path)))
    tables = []
    monkeypatch.setattr(queries, "materialize", lambda df, *a, f=queries.materialize, **b: tables.append(f(df, *a, **b)) or tables[-1])
    out = {r.slot: r for r in queries.op9_training_order(spark, str(tmp_path)).collect()}
    assert sorted(out) == list(range(len(out))) and len(written) == 1
    stored = {r.slot: bytes(r.record) for r in training_order.read_from(spark, written[0], 0).collect()}
    assert {k: hashlib.sha256(x).hexdigest() for k, x in stored.items()} == {k: r.record_sha256 for k, r in out.items()}
    assert all((r.shard, r.byte_offset) == (0, k * 2049) for k, r in out.items())
    made = tables[0].collect()
    assert sorted(bytes(r.record) for r in made) == sorted(stored.values()) and len(made) == len(out)
    assert sorted((r.doc_id, r.begin, r.n_tokens, hashlib.sha256(bytes(r.record)).hexdigest()) for r in made) == sorted((r.doc_id, r.begin, r.n_tokens, r.record_sha256) for r in out.values())
    total = sum(len(library.encode_ordinary(t or "")) + 1 for _, t, _ in rows)
    assert sum(r.n_tokens for r in out.values()) == total


def test_slots_of_sequences(docs, tmp_path):
    """Each sequence has one slot, the same with and without records, and the shards come in the order of slots."""
    training_order.pack_sequences(docs, PATH, PATTERN, 50256, 50257, 16).write.parquet(str(tmp_path / "sequences"))
    sequences = docs.sparkSession.read.parquet(str(tmp_path / "sequences"))
    out = training_order.slot_sequences(sequences, length=16, shard_rows=10).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.slot for r in out) == list(range(len(out))) and all((r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * 33) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.p].append(r.slot)
    assert all(x == sorted(x) for x in by.values()) and sum(len({s // 10 for s in x}) for x in by.values()) == -(-len(out) // 10)
    places = training_order.slot_sequences(sequences, length=16, shard_rows=10, records=False).collect()
    assert sorted(r.slot for r in places) == list(range(len(out))) and {(r.shard, r.byte_offset) for r in places} == {(r.shard, r.byte_offset) for r in out}


def test_token_ids_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [70000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert training_order.training_order(df.where("doc_id > 1"), ids="ids").count() == 2
    assert training_order.training_order(df, ids="ids", width=4).count() == 3
    with pytest.raises(Exception, match="fit"):
        training_order.training_order(df, ids="ids").count()
    with pytest.raises(ValueError, match="fit"):
        training_order.training_order(df, ids="ids", end=70000)


def test_bpe(docs, rows, library):
    out = {r.doc_id: r for r in bpe.code_digests(docs, PATH, PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, PATH, PATTERN).collect()}
    back = {r.doc_id: bytes(r.data) for r in bpe.decode_documents(bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    for d, t, _ in rows:
        want = library.encode_ordinary(t or "")
        assert ids[d] == want and back[d] == (t or "").encode()
        assert (out[d].n_tokens, out[d].ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert out[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab e's\n\t .1é中  ing'll<|", max_size=40))
def test_bpe_as_the_library(text):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.coder(PATH, PATTERN).ranks, special_tokens={})
    ids = library.encode_ordinary(text)
    coder = bpe.coder(PATH, PATTERN)
    assert coder.encode(text) == ids and coder.encode_said(text) == ",".join(map(str, ids)) and coder.decode(ids) == text.encode()


def test_bpe_of_letters_that_the_library_does_not_know(library):
    """Each letter and number of newer Unicode versions, and those around, between letters, numbers and spaces."""
    coder = bpe.coder(PATH, PATTERN)
    points = sorted({p for a, b in bpe.NEWER for p in [a - 1, b + 1, *range(a, min(b, a + 400) + 1), *range(max(a, b - 80), b + 1)]})
    texts = [f"{x}{chr(p)}{y}" for p in points for x, y in (("a", "a"), ("1", "2"), (" ", " b"), ("é", "\n"))]
    assert [t for t, ids in zip(texts, library.encode_ordinary_batch(texts, num_threads=4)) if coder.encode(t) != ids] == []
    # This vocabulary joins a letter and the first byte of these, so it tells whether they are of one match.
    toy = {bytes([i]): i for i in range(256)} | {bytes([x, b]): 256 + 128 * k + b - 128 for k, x in enumerate(b"a1") for b in range(128, 256)}
    own, theirs = bpe.TreeBPE(toy, PATTERN), tiktoken.Encoding("toy", pat_str=PATTERN, mergeable_ranks=toy, special_tokens={})
    for lead in "a1":
        texts = [lead + chr(p) for p in points if p > 127]
        assert [own.encode(t) for t in texts] == theirs.encode_ordinary_batch(texts, num_threads=4)


@pytest.mark.parametrize("text", ["a" * 5000, "abcdeé" * 900, "thanhe" * 800])
def test_bpe_of_long_pieces(text, library):
    assert bpe.coder(PATH, PATTERN).encode(text) == library.encode_ordinary(text)


ODD = [(1, None, None), (2, "", "a"), (3, "same text " * 60, "a"), (3, "same text " * 60, "a"), (None, "same text " * 60, None), (None, None, "b"), (4, "word", "b"), (3, "other text with the same id\n" * 9, "b"), (5, "long " * 70000, "b")]
OPERATORS = {
    "fingerprints": fingerprints.edit_fingerprints, "suffix": suffix_dedup.remove_repeats, "lines": line_dedup.dedup_lines, "near": order_minhash.near_duplicates, "classes": fingerprints.near_classes, "quality": quality.judge_documents,
    "mixing": mixing.mix_sources, "order": training_order.training_order, "bpe": lambda d: bpe.code_digests(d, PATH, PATTERN),
    "ids": lambda d: bpe.decode_documents(bpe.encode_documents(d, PATH, PATTERN), PATH, PATTERN),
    "lengths": lambda d: token_histogram.token_lengths(d, PATH, PATTERN),
}
CLASHING = ("size", "bucket", "k", "s", "start", "block", "target", "h", "b", "ids", "root", "text_id", "kept", "n", "lost", "spans", "part", "first", "anchor", "line")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_input(spark, name):
    df = spark.createDataFrame([(*r, "en", 1) for r in ODD], SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})
    out = OPERATORS[name](df)
    if name != "order":
        assert out.count() == len(ODD)
    else:
        assert out.count() == sum(len((t or "").encode()) // 1024 + 1 for _, t, _ in ODD)
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_odd_values(spark):
    df = spark.createDataFrame([(*r, "en", 1) for r in ODD], SCHEMA)
    near = {(r.doc_id, bytes(r.text_id)): (r.class_id, r.class_size) for r in order_minhash.near_duplicates(df).collect()}
    assert near[3, hashlib.sha256(ODD[2][1].encode()).digest()[:16]] == (3, 3)
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert removed[3, 600] == 600 and removed[None, 600] == 600 and removed[4, 4] == 0
    lines = [(r.doc_id, r.n_deleted) for r in line_dedup.dedup_lines(df).where("n_lines = 9").collect()]
    assert lines == [(3, 6)]


@pytest.mark.parametrize("name", ["op4_line_dedup", "op7_quality", "op8_mixing"])
def test_sql_says_the_same(spark, rows, tmp_path, name):
    odd = [(None if d is None else d + 1000, t, s) for d, t, s in ODD] + [(2000, "A word.\x1c\u3000\n»\n \u00a0\nYes”\u2003\nCLICK HERE\n" + "a | b » c\n" * 3, "c")]
    spark.createDataFrame([(d, t, s, "en", 1) for d, t, s in [*rows, *odd]], SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(got.columns)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_pipeline_stages(spark, docs, rows):
    out = docs.select(*corpus_pipeline.COLUMNS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, before, "").cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS and all(r.n_chars == len(r.text) for r in out.collect())
        if k == 0:
            db = duckdb.connect()
            db.register("documents", pd.DataFrame([r.asDict() for r in before.collect()]))
            judged = {d for d, kept in db.execute(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op7_quality']})").fetchall() if kept}
            assert {r.doc_id for r in out.collect()} == judged and {r.doc_id for r in out.collect()} >= set(range(40))
        if k == 1:
            kept = brute.line_runs([(r.doc_id, r.text) for r in before.collect()])
            left = {d: t for d, (t, n) in kept.items() if n == 0 or any(x.strip() for x in t.split("\n"))}
            assert {r.doc_id: r.text for r in out.collect()} == left
        if k == 2:
            classes = brute.classes([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(classes.values()))
        if k == 3:
            texts, sizes = [(r.doc_id, r.text, r.source) for r in before.collect()], Counter()
            for _, t, s in texts:
                sizes[s] += len(brute.WORD.findall(t))
            words = brute.taken(texts, _targets(sizes))
            taken = {d: int(words[d] / n + 0.5) for d, t, _ in texts if (n := len(brute.WORD.findall(t)))}
            assert Counter(r.doc_id for r in out.collect()) == Counter({d: n for d, n in taken.items() if n})
        if k == 4:
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in before.collect())


def test_pipeline_near_dedup_of_a_large_bucket(spark, monkeypatch):
    """Over 16 texts and the bytes of a block in one bucket, and no second one that two of them share: of the first 21, one is alike to all others, which are not alike; of the last 20, none is."""
    monkeypatch.setattr(linking, "BLOCK", 300)
    base = [" ".join(f"{c}{k}" for c in "abcdefgh") for k in range(2)]
    texts = [base[0], *(f"{b} more{i}" for b in base for i in range(20))]
    assert min(texts[:21], key=lambda t: hashlib.sha256(t.encode()).digest()) != texts[0]
    want = brute.classes(list(enumerate(texts)))
    assert sorted(set(want.values())) == [0, *range(21, 41)]
    df = spark.createDataFrame([(d, t, "s", "en", len(t)) for d, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").select("doc_id").collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_input(spark, k):
    df = spark.createDataFrame([(*r, "en", 1) for r in ODD], SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})
    corpus_pipeline.STAGES[k][1](spark, df, "").collect()
    assert corpus_pipeline.STAGES[k][1](spark, df.limit(0), "").count() == 0


def test_words_are_cut_as_the_pattern_says():
    texts = ["", "a b", "\x0bx\x1cy z\n", "é ü q"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, by = textvec.words(data, offsets)
    assert [[bytes(data[s:e]).decode() for s, e in zip(starts[i:j], ends[i:j])] for i, j in zip(by, by[1:])] == [brute.WORD.findall(t) for t in texts]
