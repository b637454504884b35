"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import pathlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skygrid.llm import common, html_extract, language, line_dedup, lm_score, quality
from skygrid.llm.components import connected
from skygrid.llm.fingerprint import edited_fingerprints, fingerprints
from skygrid.llm.line_dedup import LineRuns, dedup_lines
from skygrid.llm.mixing import mix_sources
from skygrid.llm.near_dedup import near_duplicates
from skygrid.llm.packing import Limits, pack_conversations, pack_documents
from skygrid.llm.tokens import WordIds
from skygrid.llm.topk import exact_top_k

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, rep long"


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), 0.5, "k", 1) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC).repartition(3)


def near_texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", "  \n\t ", "one", "one two", "ONE two", "word " * 30_000]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for edits in range(8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return [*out, out[-1], out[-1].upper(), "été Éte x " * 5]


def shingles(text, n):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80), (3, 60), (3, 50), (2, 100)])
def test_near_duplicates(spark, words, percent):
    texts = near_texts()
    sets = [shingles(t, words) for t in texts]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(group, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    got = {r.doc_id: r for r in near_duplicates(documents(spark, texts), words=words, percent=percent).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), group[i], group[i] == i)


def test_near_duplicates_of_odd_tables(spark):
    empty = documents(spark, ["x"]).where("false")
    assert near_duplicates(empty).count() == 0
    got = near_duplicates(documents(spark, ["a b c", "a b c", "x", None], [5, None, 7, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (7, 7, True), (7, 7, True)]


@pytest.mark.parametrize("percent", [85, 80, 60, 50, 30])
def test_near_duplicate_bounds_miss_few(percent):
    from math import comb

    from skygrid.llm import near_dedup

    plan, s = near_dedup.Plan.of(percent), percent / 100
    for size, bits, far in ((plan.size, 16, plan.far), (near_dedup.WIDE, 8, plan.far_wide)):
        p = (1 - s) * (1 - 2.0**-bits)
        assert sum(comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(far + 1, size + 1)) < 1e-6
    assert (1 - s**4 - 4 * s**3 * (1 - s)) ** plan.chunks <= near_dedup.MISS and plan.chunks * 4 <= plan.size


def test_near_duplicates_below_the_least_threshold(spark):
    with pytest.raises(ValueError):
        near_duplicates(documents(spark, ["a"]), percent=20)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_near_dedup", "op7_exact_top_k", "op9_mixing"])
def test_query_against_its_sql(spark, name):
    import os

    import duckdb

    from skygrid.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    key = lambda r: [str(v) for v in r]
    assert sorted(map(key, got.values.tolist())) == sorted(map(key, want.values.tolist()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in par if find(x) != x}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    line = "This line is in many documents"
    texts = [f"{line}\nown 1", f"x\n  {line.upper()}\t", f"{line}\n{line}\nshort", "short\nshort", "short", None, "", "\n\n", f"y\r\n{line}\r", "É" * 20, "é" * 20, "É" * 20 + "\n" + "long " * 50_000]
    key = lambda t: t.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    hold = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            hold[key(x)].add(i)
    got = {r.doc_id: r for r in dedup_lines(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(hold[key(x)]) >= 3 and max(hold[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert got[i].key == "k" and got[i].score == 0.5
    assert dedup_lines(documents(spark, texts).where("false")).count() == 0
    again = dedup_lines(documents(spark, [line] * 5, [None, None, 1, 2, 2]), batches=2).collect()
    assert sorted((r.doc_id or -1, r.text) for r in again) == [(-1, ""), (-1, ""), (1, ""), (2, line), (2, line)]
    two = dedup_lines(documents(spark, [line] * 5, [None, None, 2, 2, 2])).collect()  # two documents only
    assert {r.text for r in two} == {line}
    clash = documents(spark, [line] * 3).withColumn("__p0", F.lit("a")).withColumn("n_lines", F.lit("b"))
    got = dedup_lines(clash)
    assert set(got.columns) == {*clash.columns, "n_dropped"} and {r["__p0"] for r in got.collect()} == {"a"}
    assert dedup_lines(clash, counts=False).columns == clash.columns


def test_line_runs(spark):
    """Every key is fresh once, in the first batch that has it, however runs are compacted."""
    rng, want = random.Random(4), {}
    runs = LineRuns(spark, buckets=4, fanout=2)
    for b in range(7):
        rows = [(k, -k, rng.randint(1, 3), 100 - 10 * b - rng.randint(0, 9)) for k in rng.sample(range(60), 25)]
        for k, _, n, top in rows:
            old = want.get(k, (0, top))
            want[k] = old[0] + n, old[1]
        runs.add(spark.createDataFrame(rows, "lo long, hi long, n long, top long"))
    assert len(runs.levels) == 3 and sum(map(len, runs.levels)) == 3
    assert {r.lo: (r.n, r.top) for r in runs.merged().collect()} == want
    name = runs._write(spark.createDataFrame([(k, -k, 1, 0, True) for k in want], "lo long, hi long, n long, top long, fresh boolean"))
    runs.levels[0].append(name)
    with pytest.raises(Exception, match="fresh in two runs"):
        runs.merged().collect()
    runs.clear()


def test_line_dedup_writes_few_files(spark, monkeypatch):
    """What a small table's batches and runs are written to doesn't grow with the number of shuffle partitions."""
    files = []

    def delete(spark, path):
        files.append(len(list(pathlib.Path(path).rglob("part-*.parquet"))))
        common.delete(spark, path)

    monkeypatch.setattr(line_dedup, "delete", delete)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shared = "This line is in all documents"
        got = dedup_lines(documents(spark, [f"{shared}\nA line of document {i} alone\nAnother line that {i} has" for i in range(60)])).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.n_dropped for r in got} == {i: int(i < 59) for i in range(60)}
    assert len(files) == 6 and sum(files) == 4 + 5  # four batches, four runs and a compaction


def test_line_runs_of_many_tasks(spark, monkeypatch):
    """A run has one file a bucket even where it is written by more tasks than it has buckets."""
    rows = spark.range(500).selectExpr("id lo", "-id hi", "1L n", "id top", "true fresh")
    runs, deal = LineRuns(spark, buckets=3), type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *by: deal(self, 7 * n, *by))
    name = runs._write(rows)
    runs.levels[0].append(name)
    assert len(list(pathlib.Path(runs.paths[name]).glob("part-*.parquet"))) == 3
    assert {(r.lo, r.n, r.top) for r in runs.merged().collect()} == {(i, 1, i) for i in range(500)}
    runs.clear()


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


ODD = ["It's   we'LL <|endoftext|> x<|startoftext|>y", "́x é　y\x85z ΑΣ", "", None, "a1b2 !!'s —### ÷×", "<|ENDOFTEXT|>", "ab\x00c", "word " * 9000, "x" * 5000]


def thue_morse(n=1024):
    """Two words of n letters that a polynomial modulo a power of two can't tell apart."""
    x = [0]
    while len(x) < n:
        x += [1 - i for i in x]
    return "".join("ab"[i] for i in x), "".join("ba"[i] for i in x)


def test_run_hashes():
    from skygrid.llm import common

    rng = random.Random(3)
    words = ["".join(rng.choice("abAB") for _ in range(n)) for n in range(1, 40) for _ in range(30)] + [*thue_morse(), *thue_morse(64)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.runs(data, np.array([0, len(data)]))
    for fold in (True, False):
        h = common.run_hashes(data, starts, ends, fold)
        alone = [common.run_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), fold)[0] for w in words]
        assert h.tolist() == alone and len(set(alone)) == len({w.lower() if fold else w for w in words})


def test_words_that_simple_hashes_confuse(spark, tokenizer):
    from tokenizers import Tokenizer

    t, (a, b) = Tokenizer.from_file(tokenizer), thue_morse()
    rows = pack_documents(documents(spark, [a, b]).coalesce(1), tokenizer, with_ids=True).orderBy("doc_id", "start").collect()
    for i, x in enumerate((a, b)):
        assert sum((r.ids for r in rows if r.doc_id == i), []) == [*t.encode(x, add_special_tokens=False).ids, 2]
    assert {r.component_id for r in near_duplicates(documents(spark, [a, b]), words=3, percent=85).collect()} == {0, 1}


def test_token_ids_are_the_tokenizers(tokenizer):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from skygrid.llm.common import text_buffers

    t = Tokenizer.from_file(tokenizer)
    own = WordIds(tokenizer)
    for _ in range(2):
        assert [x.tolist() for x in own.encode(*text_buffers(pa.array(ODD)))] == [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_packing(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    texts = [*ODD, *[" ".join(f"w{i * j % 97}" for j in range(i * 7)) for i in range(60)]]
    rows = pack_documents(documents(spark, texts), tokenizer, with_ids=True).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, x in enumerate(texts):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == want and {r.doc_tokens for r in own} == {len(want)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and n <= 4096 and n & (n - 1) == 0
    assert pack_documents(documents(spark, texts).where("false"), tokenizer).count() == 0


def test_packing_of_conversations(spark, tokenizer):
    rows = [(c, k, "assistant" if k % 2 else "user", f"hello {c} " * (c % 9 * 20 + 1)) for c in range(40) for k in range(4)] + [(None, 0, None, None), (99, 0, "assistant", "z1 " * 6000)]
    got = pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer, limits=Limits(1024, 8, 600)).collect()
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    assert all(sum(r.length for r in s) <= 1024 and len(s) <= 8 and sum(r.n_loss for r in s) <= 600 for s in seqs.values())
    done = collections.Counter()
    for r in got:
        done[r.doc_id] += r.length
    assert all(done[r.doc_id] == r.doc_tokens for r in got) and len(done) == 42


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 1)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(1000, None, ""), (1001, [1.0, None], ""), (1002, [float("nan")], ""), (None, [1.0], "")]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 20 == 0, k=7, slab=64, block=4).collect()
    ints = np.floor(x.astype(np.float32).astype(float) * 1024).astype(np.int64)
    for q in range(0, 300, 20):
        s = ints @ ints[q]
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:7]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.rank, r.vec_id, r.score) for r in own] == [(k + 1, i, s[i]) for k, i in enumerate(want)]
    again = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 20 == 0, k=7, slab=7, block=3, head=1).collect()
    assert sorted(again) == sorted(got)
    big = spark.createDataFrame([(0, [1e30]), (20, [1e30, 5.0]), (1, []), (2, [1.0])], "vec_id long, embedding array<float>")
    assert exact_top_k(big, F.col("vec_id") == 0).count() == 3
    assert exact_top_k(big.where("false"), F.lit(True)).count() == 0


def test_top_k_of_ties_and_repeats(spark):
    """Tied scores go by id; a repeated query asks once, with its smallest vector; repeated rows are candidates each."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 5.0]), (1, [1.0, 5.0]), (3, [1.0, 7.0]), (2, [1.0, -7.0]), (4, [0.5, 1.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4, slab=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1 << 20), (1, 1 << 20), (2, 1 << 20), (3, 1 << 20)]


def test_cells_bound_products():
    from skygrid.llm.topk import Grid

    rng = np.random.default_rng(4)
    x = np.r_[rng.integers(-5000, 5000, (200, 7)), rng.integers(-(2**62), 2**62, (20, 7))]
    grid = Grid(x.min(axis=0).tolist(), x.max(axis=0).tolist())
    left, right = grid.edges(grid.cells(x))
    below, above = grid.bounds(left, right, x[:30])
    exact = x[:30].astype(object) @ x.T.astype(object)
    assert all(below[i, j] <= exact[i, j] <= above[i, j] for i in range(30) for j in range(len(x)))


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [2e9, 0.0]), (2, [3e9, 0.0]), (3, [-4e12, 1.0]), (4, [4e12, 1.0]), (5, [4e12, 1.0009765625]), (6, [1e300, 0.0]), (7, [-1e300, 0.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=10).collect()
    ints = {i: [max(-(1 << 63), min((1 << 63) - 1024, int(np.floor(x * 1024)))) for x in v] for i, v in rows}
    score = {i: max(-(1 << 63), min((1 << 63) - 1, 1024 * sum(v))) for i, v in ints.items() if i}
    want = sorted(score, key=lambda i: (-score[i], i))
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, score[i]) for i in want]


def test_fingerprints(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 400]))) for _ in range(40)] + [None, "", " \n", "a", "word " * 20_000, "ü" * 11]
    texts += [texts[1]]
    got = {r.doc_id: r for r in edited_fingerprints(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (shingles_raw(x) for x in (t, edited, nxt))
        for v, other in ((got[i].near_edited, b), (got[i].near_next, c)):
            assert v == pytest.approx(len(a & other) / len(a | other) if a | other else 1.0, abs=0.2)
    assert got[1].fingerprint == got[len(texts) - 1].fingerprint and got[40].fingerprint == ""
    odd = documents(spark, ["b b", "a a", None], [4, 4, None])
    assert edited_fingerprints(odd).count() == 3 and edited_fingerprints(odd.where("false")).count() == 0 and fingerprints(odd).count() == 3
    plan = edited_fingerprints(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_fingerprint(text, words=5):
    """Bins, densification and packing in plain Python; the hash is that of the engine's strings."""
    import xxhash

    from skygrid.llm.fingerprint import FACTORS, PRIME, SHIFTS

    w, least = text.encode().split(), {}
    for i in range(max(1, len(w) - words + 1)) if w else ():
        h = 42
        for x in w[i : i + words]:
            h = xxhash.xxh64_intdigest(x, seed=h)
        h -= (h >> 63) << 64
        least[(h >> 57) + 64] = min(h, least.get((h >> 57) + 64, h))

    out = ""
    for i in range(128 if w else 0):
        b = i if i in least else min(least, key=lambda b: (b * FACTORS[i] + SHIFTS[i]) % PRIME)
        out += f"{least[b] & 255:02x}"
    return out


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 5, 6, 20, 100, 300, 2000)] + [None, "", "\t \n", "a" * 30_000]
    got = {r.doc_id: r for r in edited_fingerprints(documents(spark, texts).withColumn("next", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (plain_fingerprint(x) for x in (t, edited, nxt))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b)
        for v, other in ((got[i].near_edited, b), (got[i].near_next, c)):
            share = sum(a[k : k + 2] == other[k : k + 2] for k in range(0, 256, 2)) / 128 if a and other else float(a == other)
            assert v == pytest.approx(max(0.0, (share - 1 / 256) / (1 - 1 / 256)) if a and other else share)


def test_hashes_of_joined_texts(spark):
    """Taken over from both texts, they are those of the joined text hashed anew, wherever it is cut."""
    from skygrid.llm.fingerprint import with_edited_hashes, with_hashes

    rng = random.Random(7)
    text = lambda: "".join(rng.choice(["a", "é", "b", " ", "\n\n", "\t"]) for _ in range(rng.randrange(80)))
    rows = [(x, y, x[: rng.randrange(len(x) + 1)], y[: rng.randrange(len(y) + 1)]) for x, y in ((text(), text()) for _ in range(300))]
    df = spark.createDataFrame(rows, "x string, y string, l string, r string").withColumn("lr", F.concat("l", "r"))
    for words in (1, 5):
        own = with_hashes(with_hashes(with_hashes(df, "x", "hx", words), "y", "hy", words), "lr", "want", words)
        got = with_edited_hashes(own, F.col("l"), F.col("r"), F.col("hx"), F.col("hy"), "got", words).collect()
        assert all(sorted(r.got) == sorted(r.want) for r in got)


def test_next_documents(spark):
    """Order by (id, text) with null, least, repeated and tied ids, over many ranges."""
    from skygrid.llm.fingerprint import with_next

    rng = random.Random(6)
    ids = [None, None, -(1 << 63), 3, 3, 3] + [rng.randrange(-50, 50) for _ in range(60)]
    rows = [(i, f"t{k:02}", "x") for k, i in enumerate(ids)]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for size in (3, 1000):
        df = spark.createDataFrame(rows, "doc_id long, text string, __p0 string").repartition(3)
        got = {r.text: r.n.text for r in with_next(df, "doc_id", "text", ["text"], "n", rows_per_bucket=size).collect()}
        assert got == {r[1]: want[(k + 1) % len(want)][1] for k, r in enumerate(want)}


def shingles_raw(t):
    w = t.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_mixing(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot").when(F.col("id") < 5900, "b").otherwise(F.lit(None)).alias("source"), F.lit("x").alias("copy"))
    got = {r.source: r["count"] for r in mix_sources(docs).groupBy("source").count().collect()}
    assert set(got) == {"hot", "b", None} and all(n == pytest.approx(2000, abs=250) for n in got.values())
    weights = spark.createDataFrame([("hot", 1.0), ("b", 0.0)], "source string, weight double")
    own = mix_sources(docs, weights=weights, total=800).groupBy("source").count().collect()
    assert len(own) == 1 and own[0].source == "hot" and own[0]["count"] == pytest.approx(800, abs=120)
    again = mix_sources(docs, seed=3)
    assert again.collect() == mix_sources(docs.repartition(7), seed=3).collect()
    assert mix_sources(docs.where("false")).count() == 0
    odd = docs.limit(40).withColumn("doc_id", F.when(F.col("doc_id") > 9, F.col("doc_id") % 3)).withColumn("__p0", F.lit("a")).withColumn("__count", F.lit("b"))
    rows = mix_sources(odd, total=400).collect()
    assert {(r["__p0"], r["__count"]) for r in rows} == {("a", "b")} and mix_sources(odd).columns == [*(c for c in odd.columns if c != "copy"), "copy"]
    times = collections.Counter((r.doc_id, r.source) for r in rows)
    assert any(i is None for i, _ in times) and all(times[i, "hot"] % 10 == 0 for i in range(3))  # rows that repeat an id draw alike


def test_language(spark):
    rng = random.Random(5)
    parts = {"aa": ["ka", "ru", "mi", "to"], "bb": ["sch", "ung", "ein", "pf"], "cc": ["ée", "oux", "ç", "elle"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(k, rng.choice([4, 30])), k) for i, k in enumerate(rng.choice(list(parts)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 3 != 0"))
    odd = spark.createDataFrame([(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !!", "aa"), (1003, "karu" * 9000, None)], docs.schema)
    got = {r.doc_id: r for r in language.predict(docs.union(odd).withColumn("score", F.lit("x")), model).collect()}
    right = [got[i].lang_pred == k for i, _, k in rows if i % 3 == 0]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    spans = language.language_spans(docs.where("doc_id < 5").unionByName(odd.where("doc_id < 1002")), model).collect()
    for r in spans:
        assert 0 <= r.start < r.end <= len(rows[r.doc_id][1].encode()) and r.lang in parts
    none = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs.limit(3), none).collect()} == {"und"}
    assert language.predict(docs.where("false"), model).count() == 0 and language.language_spans(docs, none).count() == 0
    twice = spark.createDataFrame([(1, "karu"), (1, "schung pf"), (None, "karu")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.lang_pred) for r in language.predict(twice, model).collect()) == [("1", "aa"), ("1", "bb"), ("None", "aa")]
    tied = language.Model(["y", "z"], model.ahead, model.back, np.zeros((2 * language.HIDDEN, 2), np.float32), np.zeros(2, np.float32))
    assert {r.lang_pred for r in language.predict(twice, tied).collect()} == {"y"}
    few = language.fit(docs.union(odd), max_docs=7)
    assert few.langs == ["aa", "bb", "cc"]


def plain_positions(model, text):
    """One step after another over the whole text, in plain Python but for the products."""

    def soft(x):
        return x / (1 + abs(x))

    def states(g, text):
        h, out = np.zeros(len(g.un)), []
        for x in text:
            z = 0.5 + 0.5 * soft(h @ g.uz + g.bz[x])
            r = 0.5 + 0.5 * soft(h @ g.ur + g.br[x])
            h = z * h + (1 - z) * soft((r * h) @ g.un + g.bn[x])
            out.append(h)
        return out

    logits = [np.r_[a, b] @ model.w + model.b for a, b in zip(states(model.ahead, text), states(model.back, text[::-1])[::-1], strict=True)]
    return np.array([np.exp(v) / np.exp(v).sum() for v in logits])


def test_language_network_reads_whole_texts():
    rng = np.random.default_rng(2)
    model = language._new_model(["a", "b", "c"])
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (1, 7, 64, 65, 1023, 1024, 1025, 1100, 5000)] + [b"", "é ü".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got, pooled = model.positions(data, offsets), model.pool(data, offsets)
    for i, t in enumerate(texts):
        want = plain_positions(model, t) if t else np.zeros((0, 3))
        assert np.abs(got[offsets[i] : offsets[i + 1]] - want).max(initial=0) < 1e-2
        assert pooled[i] == pytest.approx(want.mean(axis=0) if t else np.zeros(3), abs=1e-3)
    one, two = (np.frombuffer(t, np.uint8) for t in (b"the sea and wind", b"wind and sea the"))
    assert np.abs(model.pool(one, np.array([0, 16])) - model.pool(two, np.array([0, 16]))).max() > 1e-4


def test_gradients():
    model = language._new_model(["a", "b"], seed=7, kind=np.float64)
    x, y = np.random.default_rng(1).integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])

    def loss():
        p = [plain_positions(model, x[:, k].tolist())[:, y[k]] for k in range(4)]
        return -np.log(p).mean()

    for p, g in zip(model.params(), language.gradients(model, x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-5
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=1e-3, abs=1e-8)


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "of", "sea", "and", "wind", "hill"]) + rng.choice(["", ",", "."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["buy", "sea", "now", "wind"]) + "!!" for _ in range(60))
    texts = [good() if i % 2 else bad() for i in range(400)] + [None, "", "x " * 30_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 3)] + [(None, 1, 0), (7, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.with_score(docs, model).collect()}
    assert np.mean([(got[i].score > 0.5) == (i % 2 == 1) for i in range(400)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 403 and got[0].key == "k"
    kept = quality.with_score(docs, model, keep_from=0.7)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.7}
    nothing = quality.fit(docs.where("false"), labels.where("false"))
    assert quality.with_score(docs.limit(2), nothing).count() == 2


def test_quality_has_a_vector_for_every_token(spark):
    """Word vectors and document means against brute force, with more tokens than any fixed table of 2**14 rows could keep apart."""
    import pyarrow as pa

    from skygrid.llm.common import text_buffers

    rng = random.Random(9)
    texts = [" ".join(f"{'abcdefgh'[rng.randrange(8)]}{''.join(rng.choice('klmnopqrst') for _ in range(5))}" for _ in range(50)) for _ in range(600)] + [None, "", "a b a a , 12"]
    words = quality.word_vectors(documents(spark, texts).select("text"), block_bytes=20_000, bucket_bytes=30_000)
    tokens = [quality.token_keys(*text_buffers(pa.array([t], pa.string())))[0] for t in texts]
    want, usual = collections.defaultdict(lambda: np.zeros(quality.DIM + 1, np.int64)), np.zeros(quality.DIM)
    for keys in tokens:
        places, signs = quality.index_vectors(keys)
        np.add.at(usual, places, signs)
        for i, j in itertools.permutations(range(len(keys)), 2):
            if abs(i - j) <= quality.WINDOW:
                np.add.at(want[int(keys[i])], places[j], signs[j].astype(np.int64))
                want[int(keys[i])][-1] += 1
    usual /= sum(map(len, tokens))
    vector = {k: np.where(v[:-1] > v[-1] * usual, 1, -1) for k, v in want.items()}
    rows = words.table.collect()
    assert len(rows) == words.buckets > 1 and len(want) > 1 << 14
    got = {}
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["vectors"], np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        got |= dict(zip(quality.unpack_keys(r["keys"]).tolist(), 2 * bits.astype(int) - 1))
    assert set(got) == set(vector) and all((got[k] == vector[k]).all() for k in vector)
    keep = lambda table, x: pa.table([*table.columns, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])
    own = [*texts[-5:], texts[-1], "unseen"]
    docs = documents(spark, own, [0, 1, 2, None, 4, 4, 6])
    rows = quality.features(docs.select("doc_id", "text"), "text", words, keep, "doc_id long, x binary", block_bytes=500).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["0", "1", "2", "4", "4", "6", "None"]
    for r in rows:
        i = 3 if r.doc_id is None else r.doc_id
        keys = quality.token_keys(*text_buffers(pa.array([own[i]], pa.string())))[0]
        v = np.array([vector.get(int(k), np.zeros(quality.DIM)) for k in keys]).reshape(-1, quality.DIM)
        assert np.frombuffer(r.x, np.float32) == pytest.approx(v.mean(axis=0) if len(v) else np.zeros(quality.DIM), abs=1e-5)


def test_quality_of_repeats_and_clashing_columns(spark):
    """Rows that repeat keep their number, private columns don't clash, the network's score is what a plain pass gives."""
    docs = documents(spark, ["a b", "a b", None, "", "c " * 9], [1, 1, None, 3, 3]).withColumn("__p0", F.lit("x")).withColumn("__p1", F.lit(2))
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0), (1, 1)], "doc_id long, quality int"))
    got = quality.with_score(docs, model)
    assert set(got.columns) == set(docs.columns) and got.count() == 5 and {r["__p0"] for r in got.collect()} == {"x"}
    assert quality.with_score(docs, model, keep_from=0.0).count() == 5 and quality.scores(docs.select("doc_id", "text").where("false"), model).count() == 0
    x, rng = np.random.default_rng(0).normal(size=(50, 6)), np.random.default_rng(1)
    net = quality.train(x, (x[:, 0] > 0).astype(float))
    for row in x[:5]:
        z = (row - net.mean) / net.scale
        h = [np.tanh(sum(z[i] * net.w1[i, j] for i in range(6)) + net.b1[j]) for j in range(len(net.b1))]
        logit = sum(a * b for a, b in zip(h, net.w2)) + net.b2
        assert net.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)))


@pytest.mark.parametrize("block_bytes", [lm_score.BLOCK_BYTES, 64, 3000])
def test_lm_score(spark, block_bytes):
    rng = random.Random(5)
    texts = ["the sea and the sea", "buy now Buy now", None, "", " \t\n", "word " * 20_000, "a Été\x0bété b", "the sea and the sea"]
    texts += [" ".join(rng.choice("the sea and wind rain of salt".split()) for _ in range(40)) for _ in range(30)]
    docs = documents(spark, [*texts, "no id", "twice", "twice"], [*range(len(texts)), None, 7, 7])
    goals = ["the sea and the wind", None, "salt  of the SEA"]
    target = spark.createDataFrame([(t,) for t in goals], "text string")

    def words(text):
        return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()

    def model(texts):
        pairs = collections.Counter(p for t in texts for p in itertools.pairwise([None, *words(t)]))
        single, context = collections.Counter(), collections.Counter()
        for (v, w), n in pairs.items():
            single[w] += n
            context[v] += n
        return pairs, single, context, sum(single.values())

    models = [model(goals), model([*texts, "no id", "twice", "twice"])]
    both = sum(m[3] for m in models)

    def loss(text, m):
        w, (pairs, single, context, n) = words(text), models[m]
        p = [0.6 * pairs[v, x] / max(context[v], 1) + 0.35 * single[x] / n + 0.05 * sum(k[1][x] for k in models) / both for v, x in itertools.pairwise([None, *w])]
        return -np.log2(p).mean() if w else 0.0

    got = lm_score.cross_entropy_difference(docs, target, block_bytes=block_bytes).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(texts) + 3 and len(by[None]) == 1 and len(by[7]) == 3
    for i, t in [*enumerate(texts), (None, "no id")]:
        r = min(by[i], key=lambda r: abs(r.n_tokens - len(words(t))))
        assert r.n_tokens == len(words(t)) and r.target_loss == pytest.approx(loss(t, 0)) and r.background_loss == pytest.approx(loss(t, 1))
        assert r.score == pytest.approx(r.target_loss - r.background_loss)
    assert by[0][0].score < by[1][0].score


def test_lm_score_of_odd_tables(spark):
    docs, target = documents(spark, ["a b", None]), spark.createDataFrame([("a b",)], "text string")
    assert lm_score.cross_entropy_difference(docs.where("false"), target).count() == 0
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, target.where("false")).collect()}
    assert got[0].target_loss == pytest.approx(-np.log2(0.05 * 0.5)) and got[1].score == 0
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64))
    assert (lm_score.unpack_keys(lm_score.pack_keys(keys)) == keys).all()
    at = lm_score.bucket_bounds(keys, 7)
    assert at[0] == 0 and at[-1] == 5000 and len(at) == 8


def test_html(spark):
    page = "<html><body class='x'><nav>menu</nav><div class='cookie-note'>We</div><div><span>Site box</span></div><article><h1>T&eacute;&nbsp;x</h1><p>One<br>two<p><b>three<div class='ad'>Buy</div><ul><li>a<li>b</ul><section id=comments><p>Nice</section></article><script>var t='</p>'</script><footer>f</footer>"
    assert html_extract.main_text(page) == "Té x\n\nOne two\n\nthree\n\na\n\nb"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<!-- x") == ""
    bare = "<body><div><p>Site box</p></div><p>Page {}</p></body>"
    rows = [(i, "http://H.example:80/x", bare.format(i)) for i in range(6)] + [(9, None, None), (10, "http://other/", bare.format(1)), (10, "http://other/", bare.format(1)), (11, "http://o/", "<p>" + "long " * 60_000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(6)] == [f"Page {i}" for i in range(6)] and got[9].text == ""
    assert got[10].text == "Site box\n\nPage 1" and got[11].n_chars == 5 * 60_000 - 1
    joined = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), max_shared=0)
    assert {r.page_id: r.text for r in joined.collect()} == {i: r.text for i, r in got.items()}


def test_html_templates_of_large_hosts(spark):
    """A block on five different pages is template whatever the size of its host; one on four, and copies of a page, are not."""
    page = lambda i, box: f"<body><div><p>{box}</p></div><p>Page {i}</p></body>"
    rows = [(i, "http://h/", page(i, "Often" if i < 5 else "Seldom" if i < 9 else f"Own {i}")) for i in range(300)]
    rows += [(300 + k, "http://h/", page(300, "Copy")) for k in range(9)] + [(400 + i, "http://g/", page(i, "Often")) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Page {i}" if i < 5 else f"Seldom\n\nPage {i}" if i < 9 else f"Own {i}\n\nPage {i}" for i in range(300)}
    want |= {300 + k: "Copy\n\nPage 300" for k in range(9)} | {400 + i: f"Often\n\nPage {i}" for i in range(4)}
    for most in (100_000, 0):
        assert {r.page_id: r.text for r in html_extract.extract(pages, max_shared=most).collect()} == want


def test_html_templates_without_telling_marks(spark):
    """Pages that say nothing about their parts: templates alone tell them, against a counter on the strings the pages were made of."""
    rng = random.Random(7)
    boxes = {h: [f"<div><p>{h} box {k}</p><ul><li>Home {k}<li>More</ul></div>" for k in range(6)] for h in ("h1", "h2", "h3")}
    rows, parts = [], []
    for i in range(90):
        host = rng.choice(list(boxes))
        own = [f"<div><p>Story {i} {k} {rng.random()}</p></div>" for k in range(3)] + rng.sample(boxes[host], rng.choice([0, 1, 2]))
        rng.shuffle(own)
        parts.append((host, own))
        rows.append((i, f"https://{host}/p{i}", f"<html><body class=page>{''.join(own)}</body></html>"))
    count = collections.Counter((h, x) for h, own in parts for x in set(own))
    plain = lambda x: [y for y in (z.split("<")[0] for z in x.split(">")) if y]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("a", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for i, (h, own) in enumerate(parts):
        assert got[i] == "\n\n".join(y for x in own if count[h, x] < 5 for y in plain(x))
    assert any(count[h, x] >= 5 for h, own in parts for x in own)
    empty = pages.where("false")
    assert html_extract.extract(empty).count() == 0 and html_extract.site_templates(empty).count() == 0
    named = spark.createDataFrame([("p", "https://h1/", rows[0][2])], "page_id string, url string, html string")
    assert html_extract.extract(named).first().page_id == "p"


@pytest.mark.parametrize("quote", ["'", '"'])
def test_html_of_long_attributes(quote):
    for n in (10, 5000, 300_000):
        value = "x" * n + " 1>0 <script> tail"
        assert html_extract.main_text(f"<div data-x={quote}{value}{quote}>Body</div><p>end</p>") == "Body\n\nend"
    assert html_extract.main_text(f"<p>a</p><div title={quote}{'x' * 5000}>b</div><p>c</p>") == "a\n\nb\n\nc"


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "class='content with-sidebar'", "id=page class='site no-header'", "class='post social-enabled'", "class='search-result-page'", "class='sidebar-left'"])
@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_html_wrappers_with_marks(wrapper, tag):
    """A wrapper of the content stays whatever its class says, its marked parts go."""
    body = "<h1>Title</h1><p>" + "words of the article " * 9 + "</p>"
    parts = "<div class='sidebar'><article>Teaser</article></div><div class='share-links'>Share</div><section class=comments><article>Nice</article></section>"
    page = f"<body><header>Head</header><div {wrapper}><{tag}>{body}</{tag}>{parts}</div><div class='cookie-note'>We</div><footer>f</footer>"
    inside = html_extract.main_text(page)
    assert inside == "Title\n\n" + ("words of the article " * 9).strip()
    beside = f"<body><{tag}>{body}</{tag}>{parts}<div class='related-posts'><article>Other</article></div>"
    if tag != "div":
        assert html_extract.main_text(beside) == inside
    assert html_extract.main_text(f"<body><article>{body}</article><div hidden class=sidebar><main>No</main></div>") == inside


def plain_lines(rows):
    """Line dedup of (id, text) rows in plain Python; a null id is one document, smaller than any."""
    key = lambda t: t.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    hold = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            hold[key(x)].add(-1 if i is None else i)
    goes = lambda i, x: len(key(x)) >= 20 and len(hold[key(x)]) >= 3 and max(hold[key(x)]) != (-1 if i is None else i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if not goes(i, x))) for i, t in rows]


def plain_near(rows):
    """The (id, text) rows that near-dedup keeps: the least id of each group, one of equal rows."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t, 5)) for i, t in rows]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        both = len(a & b)
        if 100 * both >= 80 * (len(a) + len(b) - both) and top(i) != top(j):
            root[max(top(i), top(j))] = min(top(i), top(j))
    return sorted({(i, t) for i, t in rows if i is None or top(i) == i}, key=repr)


def plain_copies(rows, temperature=0.7, seed=17):
    """How often mixing repeats each (id, source) row."""
    sizes = collections.Counter(s for _, s in rows)
    total = sum(n**temperature for n in sizes.values())
    out = []
    for i, s in rows:
        rate = len(rows) * sizes[s] ** temperature / total / sizes[s]
        parts = max(1, int(np.ceil(rate / 16)))
        n = 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}:{'null' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = np.exp(-rate / parts)
            k = 0
            while c <= u:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        out.append(n)
    return out


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    line = "A line that several documents share"
    texts = near_texts()[:40] + [" ".join(rng.choice(["buy", "now"]) + "!!" for _ in range(40)) for _ in range(20)] + [None, "", line, f"{line}\nown", f"{line.upper()}\nother words"]
    ids = [*range(len(texts)), 7, 7, None, None]
    texts += [texts[7], "another text of seven with some words", "no id", "no id"]
    rows = [(i, t, "en", f"s{k % 3}" if k % 11 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).withColumn("__p0", F.lit("clash")).withColumn("__n", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = docs.where("false")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "packing":
            assert out.columns == docs.columns
            assert {r["__p0"] for r in out.collect()} == {"clash"}
        out.write.parquet(str(tmp_path / f"{k}"))
        assert stage(spark, empty, str(tmp_path)).count() == 0
        found = spark.read.parquet(str(tmp_path / f"{k}"))
        after = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) if name != "packing" else []
        if name == "quality":
            assert set(after) <= set(before) and {i for i, _ in after if i is not None and i < 40} >= set(range(7, 40)) and not {i for i, _ in after if i is not None} & set(range(40, 60))
        elif name == "line_dedup":
            assert after == sorted(plain_lines(before), key=repr)
            assert all(r.n_chars == len(r.text) for r in found.collect())
        elif name == "near_dedup":
            assert after == plain_near(before)
        elif name == "mixing":
            own = docs.collect()
            want = collections.Counter()
            for r, n in zip(own, plain_copies([(r.doc_id, r.source) for r in own])):
                want[r.doc_id, r.text] += n
            assert collections.Counter(after) == +want
        else:
            sizes = collections.Counter()
            for r in found.collect():
                sizes[r.doc_id] += r.length
            assert set(sizes) == {i for i, _ in before}
        docs = found
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
