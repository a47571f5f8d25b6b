"""Operators against literal simulations and hand-made cases."""

import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import cli, shared
from weftline.config import JoinParams, SketchParams
from weftline.functions import rolling
from weftline.functions.sequence import twobit_decode, twobit_encode, twobit_slice
from weftline.operators import arrow_sketch, arrow_stages, bloom, cells, index, matching, report, sketch, stored
from weftline.operators.stored import store_index
from weftline.plans import registry
from weftline.sources import reads as sources
from weftline.streaming import query_mode
from weftline.streaming.query_mode import stream_overlaps


def sequences(spark, *seqs):
    return spark.createDataFrame([(i, f"r{i}", len(s), s) for i, s in enumerate(seqs)], "read_id long, name string, raw_length long, sequence string")


def occurrences(spark, *rows):
    return spark.createDataFrame(rows, "key string, read_id long, fw boolean, start long, end long, raw_length long")


def kmer_hash(kmer):
    """Polynomials of the code points to two bases, the fifth power of each modulo the prime."""
    out = 0
    for base in rolling.BASES:
        out = (out << 31) + pow(sum(ord(c) * pow(base, len(kmer) - 1 - i) for i, c in enumerate(kmer)), 5, rolling.PRIME)
    return out


def simulate(seq, k, n, w):
    """Window vectors by brute force: leftmost smallest hash of w + 1 k-mers in each window, emitted on change."""
    h = [kmer_hash(seq[i : i + k]) for i in range(len(seq) - k + 1)]
    out, last = [], None
    for s in range(len(seq) - n * w - k + 1):
        best = [min((h[i], i) for i in range(j * w + s, (j + 1) * w + s + 1)) for j in range(n)]
        v = tuple(x[0] for x in best)
        if v != last:
            out.append((s, v, best[0][1], best[-1][1]))
        last = v
    return out


@pytest.mark.parametrize(("k", "n", "w", "block"), [(2, 1, 1, 3), (3, 2, 4, 5), (5, 3, 2, 1), (4, 2, 7, 4096)])
def test_emissions_equal_simulation(spark, k, n, w, block):
    rng = random.Random(k * 100 + w)
    seqs = ["".join(rng.choice("AC" if i % 2 else "ACGT") for _ in range(rng.randint(0, 60))) for i in range(25)] + ["A" * 40, "", "ACGT" * 12]
    p = SketchParams(k, n, w, "none", block)
    got = {}
    for r in sketch.emitted(sequences(spark, *seqs), p).collect():  # as exploded rows Spark would push a filter through all stages
        for x in r["e"] if r["fw"] else []:
            got.setdefault(r["read_id"], []).append((x["shift"], tuple(x["v"]), x["a"] + r["base"], x["z"] + r["base"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: e for i, s in enumerate(seqs) if (e := simulate(s, k, n, w))}


@pytest.mark.parametrize(("k", "n", "w", "mask"), [(2, 1, 1, "none"), (3, 2, 4, "hpc"), (5, 3, 2, "microsat"), (4, 2, 7, "hpc")])
def test_arrow_sketch_equals_column_functions(spark, k, n, w, mask):
    rng = random.Random(k * 100 + w)
    seqs = ["".join(rng.choice("AC" if i % 2 else "ACGT") for _ in range(rng.randint(0, 90))) for i in range(20)] + ["A" * 40, "", "ACGT" * 12, "ACGTN" * 9]
    p = SketchParams(k, n, w, mask, 7)
    df = sequences(spark, *seqs)
    assert sorted(map(tuple, sketch.chunks(df, p).collect())) == sorted(map(tuple, sketch.chunks(df, p, columns_only=True).collect()))


def test_arrow_sketch_in_small_pieces_and_blocks(monkeypatch):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("AC") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    chars, at = arrow_sketch._chars(pa.array([*seqs, None, "é" * 20 + "ACGT" * 9]), 0, 32)
    for n, mask in ((1, "none"), (3, "hpc"), (2, "microsat")):
        got = []
        for block, piece in ((1 << 16, 1 << 18), (1, 1), (7, 64), (33, 1)):
            monkeypatch.setattr(arrow_sketch, "PIECE", piece)
            got.append([x.tolist() for x in arrow_sketch.sketch_strands(chars, at, SketchParams(4, n, 5, mask, block))])
        assert len(got[0][0]) and all(x == got[0] for x in got)


def test_hot_keys_are_joined_whole(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 40}", i % 25, bool(i % 2), a := rng.randrange(90), a + rng.randrange(30), 500) for i in range(400)]
    c = occurrences(spark, *rows)
    for both in (False, True):
        want = sorted((a[0], a[1], b[1], a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and (a[1] != b[1] if both else a[1] < b[1]) and abs((a[4] - a[3]) - (b[4] - b[3])) <= 20)
        for split in (7, 50, 4096):
            got = matching.matches(c, JoinParams(max_length_difference=20, split=split), both)
            assert sorted((r["key"], r["left"], r["right"], r["l_start"], r["r_start"]) for r in got.collect()) == want
    few = matching.matches(c, JoinParams(max_length_difference=20, max_coverage=60, split=7)).collect()
    assert few and all(r["key"] != "hot" for r in few)


def test_long_lists_come_in_pieces(spark):
    c = occurrences(spark, *[("k", i, True, 0, 9, 50) for i in range(50)])
    pieces = index.buckets(c, 8).collect()
    assert len(pieces) == 7 and max(len(r["occurrences"]) for r in pieces) <= 8 and sorted(x["read_id"] for r in pieces for x in r["occurrences"]) == list(range(50))
    sets = matching.pair_sets(c, size=8).where("read_id = 3").collect()
    assert len(sets) == 7 and sorted(x for r in sets for x in r["partners"]) == [i for i in range(50) if i != 3] and {r["n_partners"] for r in sets} == {49}


def test_too_short_and_shortest(spark):
    p = SketchParams(3, 2, 4, "none")
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(p.span))
    assert sketch.emitted(sequences(spark, s[:-1]), p).count() == 0
    assert sketch.blocks(sketch.masked(sketch.strands(sequences(spark, s)), "none"), p).first()["shifts"] == 1


def test_equal_hashes_emit_once_leftmost(spark):
    e = sketch.emitted(sequences(spark, "A" * 50), SketchParams(3, 2, 4, "none")).first()["e"]
    assert len(e) == 1 and e[0]["a"] == 0


def test_masks(spark):
    def syms(seq, mask):
        return [(x["s"], x["a"], x["z"]) for x in sketch.masked(sketch.strands(sequences(spark, seq)), mask).where("fw").first()["syms"]]

    assert syms("AACCCG", "none") == [(c, i, i) for i, c in enumerate("AACCCG")]
    assert syms("AACCCG", "hpc") == [("A", 0, 1), ("C", 2, 4), ("G", 5, 5)]
    assert syms("TACACACGG", "microsat") == [("T.", 0, 0), ("AC.", 1, 6), ("G.", 7, 8)]
    with pytest.raises(ValueError):
        SketchParams(mask="other")


def test_length_difference_bound(spark):
    c = occurrences(spark, ("k", 0, True, 0, 100, 500), ("k", 1, True, 0, 110, 500), ("k", 2, True, 0, 111, 500))
    got = {(r["left"], r["right"]) for r in matching.matches(c, JoinParams(max_length_difference=10)).collect()}
    assert got == {(0, 1), (1, 2)}


def test_coverage_bounds_are_inclusive(spark):
    c = occurrences(spark, *[(f"k{n}", i, True, 0, 9, 50) for n in (1, 2, 3, 4) for i in range(n)])
    assert {r["key"] for r in index.covered(c, JoinParams(min_coverage=2, max_coverage=3)).collect()} == {"k2", "k3"}


def test_key_of_one_read_only(spark):
    c = occurrences(spark, ("k", 0, True, 0, 9, 50), ("k", 0, True, 20, 29, 50))
    assert index.covered(c).count() == 2 and matching.matches(c).count() == 0 and matching.reads_with_match(c).count() == 0
    assert index.chunk_counts(c).first().asDict() == {"distinct_chunks": 1, "singleton_chunks": 0}


@pytest.mark.parametrize(
    ("l_fw", "r_fw", "want"),
    [(False, False, (800, 899, 650, 749, True)), (False, True, (800, 899, 650, 749, False)), (True, False, (100, 199, 50, 149, False)), (True, True, (100, 199, 50, 149, True))],
)
def test_strand_normalisation(spark, l_fw, r_fw, want):
    m = spark.createDataFrame([(0, 1, 100, 199, 50, 149, l_fw, r_fw, 1000, 800)], "left long, right long, l_start long, l_end long, r_start long, r_end long, l_fw boolean, r_fw boolean, l_len long, r_len long")
    r = matching.normalised(m).first()
    assert (r["l_start"], r["l_end"], r["r_start"], r["r_end"], r["r_fw"]) == want and r["l_fw"]


@pytest.mark.parametrize(("shift", "boxes"), [(700, [(0, 300, 0, 800)]), (701, [(0, 100, 0, 100), (200, 300, 701, 801)])])
def test_chain_gap(spark, shift, boxes):
    m = spark.createDataFrame([(0, 1, 0, 100, 0, 100, True, 900, 900), (0, 1, 200, 300, shift, shift + 100, True, 900, 900)], "left long, right long, l_start long, l_end long, r_start long, r_end long, r_fw boolean, l_len long, r_len long")
    assert sorted((r["l_start"], r["l_end"], r["r_start"], r["r_end"]) for r in matching.chains(m).collect()) == boxes


def test_masked_keys(spark):
    c = occurrences(spark, *[(k, i, True, 0, 9, 50) for k in "abc" for i in range(2)])
    allow, deny = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("b",)], "key string")
    keys = lambda df: {r["key"] for r in df.collect()}
    assert keys(index.masked_keys(c)) == set("abc") and keys(index.masked_keys(c, allow)) == set("ab") and keys(index.masked_keys(c, allow, deny)) == {"a"}


def test_twobit(spark):
    df = spark.createDataFrame([("acgtACGTA",), ("",), ("ACN",), ("TTTTT",)], "s string")
    out = df.select("s", twobit_encode(F.col("s")).alias("b")).select("s", "b", twobit_decode(F.col("b"), F.length("s")).alias("d"), twobit_slice(F.col("b"), F.length("s"), 3, 4).alias("p")).collect()
    assert [r["d"] for r in out] == ["ACGTACGTA", "", None, "TTTTT"] and out[0]["p"] == "TACG" and bytes(out[0]["b"]) == bytes([0b11100100, 0b11100100, 0])


def test_fasta_fastq_and_gzip(spark, tmp_path):
    fasta = tmp_path / "a.fa.gz"
    fasta.write_bytes(gzip.compress(b">one first\nACGT\nAC\n>two\nGG\n"))
    got = [(r["read_id"], r["name"], r["raw_length"], r["sequence"]) for r in sources.fasta_reads(spark, str(fasta)).orderBy("read_id").collect()]
    assert got == [(0, "one", 6, "ACGTAC"), (1, "two", 2, "GG")]
    fastq = tmp_path / "a.fq"
    fastq.write_text("@one x\nACGT\n+\n@@@@\n@two\nGG\n+two\nII\n")
    got = [(r["read_id"], r["name"], r["sequence"]) for r in sources.fastq_reads(spark, str(fastq)).orderBy("read_id").collect()]
    assert got == [(0, "one", "ACGT"), (1, "two", "GG")]


def test_many_small_files_and_empty_reads(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02}.fa").write_text(f">a{i}\nACGT\n>b{i}\nGG\nTT\n")
        (tmp_path / f"{i:02}.fq").write_text(f"@a{i}\nACGT\n+\n@+@+\n@b{i}\n\n+\n\n@c{i} x\nGG\n+c{i}\n+@\n")
    got = [(r["read_id"], r["name"], r["sequence"]) for r in sources.fasta_reads(spark, str(tmp_path / "*.fa")).orderBy("read_id").collect()]
    assert got == [(2 * i + k, f"{'ab'[k]}{i}", ("ACGT", "GGTT")[k]) for i in range(30) for k in range(2)]
    got = [(r["read_id"], r["name"], r["raw_length"], r["sequence"]) for r in sources.fastq_reads(spark, str(tmp_path / "*.fq")).orderBy("read_id").collect()]
    assert got == [(3 * i + k, f"{'abc'[k]}{i}", (4, 0, 2)[k], ("ACGT", "", "GG")[k]) for i in range(30) for k in range(3)]
    (tmp_path / "blank.fastq").write_text("\n@one\nAC\n+\n@@\n\n\n@two\nGG\n+\n+I\n\n@cut\nAC\n")
    assert sorted((r["name"], r["sequence"]) for r in sources.fastq_reads(spark, str(tmp_path / "blank.fastq")).collect()) == [("one", "AC"), ("two", "GG")]


def near_copies(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    other = base[:150] + "".join(rng.choice("ACGT") for _ in range(20)) + base[150:]
    return sequences(spark, base, other, "".join(rng.choice("ACGT") for _ in range(300)))


def test_tsv_round_trip_and_reverse_overlap(spark, tmp_path):
    r = near_copies(spark)
    flipped = r.withColumn("sequence", F.when(F.col("read_id") == 1, F.reverse(F.translate("sequence", "ACGT", "TGCA"))).otherwise(F.col("sequence")))
    p = SketchParams(11, 2, 10)
    for df, strand in ((r, "fw"), (flipped, "bw")):
        found = report.overlaps(df, p)
        got = {(x["left"], x["right"], x["right_strand"]) for x in found.collect()}
        assert ("r0", "r1", strand) in got and all("r2" not in x for x in got)
        sources.write_overlaps(found, str(tmp_path / strand))
        assert sorted(map(tuple, sources.read_overlaps(spark, str(tmp_path / strand)).collect())) == sorted(map(tuple, found.collect()))


def test_stream_equals_batch(spark, tmp_path):
    r, p = near_copies(spark), SketchParams(7, 2, 10)
    r.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = store_index(r, "kept", p, buckets=3)
    q = stream_overlaps(stream, kept, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    batch = report.query_overlaps(r, r, p)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    assert any(x["left"] == x["right"] for x in batch.collect())  # a query that is in the index is reported
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = kept.overlaps(r)._jdf.queryExecution().optimizedPlan().toString(), matching.query_matches(sketch.chunks(r, p), kept.chunks(spark))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan[1].count("Exchange hashpartitioning") == 1  # the index is not shuffled
    kept.drop(spark)


def test_command_line(spark, tmp_path, capsys):
    rows = near_copies(spark).collect()
    (tmp_path / "a.fa").write_text("".join(f">{r['name']}\n{r['sequence']}\n" for r in rows[:2]))
    (tmp_path / "b.fq").write_text("".join(f"@{r['name']}\n{r['sequence']}\n+\n{'I' * len(r['sequence'])}\n" for r in rows[2:]))
    own = ["--k", "11", "--num-windows", "2", "--window-size", "10"]
    cli.main(["overlaps", str(tmp_path / "all"), str(tmp_path / "a.fa"), str(tmp_path / "b.fq"), *own], spark)
    cli.main(["query", str(tmp_path / "query"), str(tmp_path / "a.fa"), str(tmp_path / "b.fq"), str(tmp_path / "a.fa"), *own], spark)
    assert {(r["left"], r["right"]) for r in sources.read_overlaps(spark, str(tmp_path / "all")).collect()} == {("r0", "r1")}
    assert {(r["left"], r["right"]) for r in sources.read_overlaps(spark, str(tmp_path / "query")).collect()} == {("r0", "r0"), ("r0", "r1"), ("r1", "r0"), ("r1", "r1")}
    assert "number_reads\t3" in capsys.readouterr().err


def test_written_tables_go(spark):
    import os

    t = shared.written(spark.range(5))
    assert shared.written(t) is t and t.count() == 5
    shared.dropped(t, spark.range(1))
    assert not os.path.exists(t._weftline_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tandem_runs_equal_regular_expression(spark):
    import re

    tandem = re.compile(r"(.{1,6}?)\1+|.", re.S)
    rng = random.Random(9)
    seqs = ["", "A", "AAAA", "ACACACA", "ACGTTACGTTACGTT", "ABCDEFGABCDEFG"] + ["".join(rng.choice("AC" if i % 3 else "ACGT") for _ in range(rng.randint(0, 200))) for i in range(120)]
    rows = spark.createDataFrame([(i, True, len(s), s) for i, s in enumerate(seqs)], "read_id long, fw boolean, raw_length long, seq string")
    for r in arrow_sketch.tandem_runs(rows).collect():
        want = [(m.start(), len(m[1] or m[0])) for m in tandem.finditer(seqs[r["read_id"]])]
        assert list(zip(r["starts"], r["motifs"], strict=True)) == want


@pytest.mark.parametrize(("gap", "width"), [(5, 8), (5, 3), (500, 1 << 15), (0, 1)])
def test_chains_over_ranges_of_diagonals(spark, monkeypatch, gap, width):
    monkeypatch.setattr(matching, "DIAGONALS", width)
    rng = random.Random(width)
    rows = []
    for _ in range(700):
        pair = (0, 1, True) if rng.random() < 0.4 else (rng.randrange(3), 3 + rng.randrange(3), rng.random() < 0.5)
        a, d = rng.randrange(100), rng.choice([-700, 0, 3, 4000]) + rng.randrange(-25, 25) * rng.choice([1, 1, 6])
        rows.append((pair[0], pair[1], a, a + 9, a + d, a + d + 9, pair[2], 5000, 5000))
    want = []
    for pair in {(r[0], r[1], r[6]) for r in rows}:
        mine = sorted((r for r in rows if (r[0], r[1], r[6]) == pair), key=lambda r: r[4] - r[2])
        box = None
        for r in mine:
            if box and (r[4] - r[2]) - box[-1] <= gap:
                box = [*pair, min(box[3], r[2]), max(box[4], r[3]), min(box[5], r[4]), max(box[6], r[5]), box[7] + 1, r[4] - r[2]]
            else:
                want += [tuple(box[:-1])] if box else []
                box = [*pair, r[2], r[3], r[4], r[5], 1, r[4] - r[2]]
        want.append(tuple(box[:-1]))
    m = spark.createDataFrame(rows, "left long, right long, l_start long, l_end long, r_start long, r_end long, r_fw boolean, l_len long, r_len long")
    found = matching.chains(m, JoinParams(chain_gap=gap))
    assert sorted((r["left"], r["right"], r["r_fw"], r["l_start"], r["l_end"], r["r_start"], r["r_end"], r["n_matches"]) for r in found.collect()) == sorted(want)


def test_a_hot_pair_is_spread(spark, monkeypatch):
    monkeypatch.setattr(matching, "DIAGONALS", 16)
    m = spark.range(4000).selectExpr("0L as left", "1L as right", "id % 50 as l_start", "id % 50 + 9 as l_end", "id % 50 + id as r_start", "id % 50 + id + 9 as r_end", "true as r_fw", "9000L as l_len", "9000L as r_len")
    found = matching.chains(m, JoinParams(chain_gap=2))
    text = plan(found)
    shuffles = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
    assert any("diagonal" in x for x in shuffles) and any("range" in x for x in shuffles)  # matches go by diagonal, diagonals by range
    r = found.collect()
    assert len(r) == 1 and r[0]["n_matches"] == 4000


def test_counters_and_overlaps_of_one_run(spark, tmp_path, monkeypatch, capsys):
    r, p, calls = near_copies(spark), SketchParams(11, 2, 10), []
    sketched, joined = report.chunks, report.matches
    monkeypatch.setattr(report, "chunks", lambda *a, **b: calls.append("chunks") or sketched(*a, **b))
    monkeypatch.setattr(report, "matches", lambda *a, **b: calls.append("matches") or joined(*a, **b))
    before = set(shared._paths)
    with shared.scope():
        done = report.run(r, p)
        assert sorted(map(tuple, done.overlaps().collect())) == sorted(map(tuple, report.overlaps(r, p).collect()))
    assert calls.count("matches") == 2 and set(shared._paths) == before  # one for each of the two
    assert report.stats(r, p).first().asDict() == done.counters and set(shared._paths) == before
    calls.clear()
    (tmp_path / "a.fa").write_text("".join(f">{x['name']}\n{x['sequence']}\n" for x in r.collect()))
    cli.main(["overlaps", str(tmp_path / "all"), str(tmp_path / "a.fa"), "--k", "11", "--num-windows", "2", "--window-size", "10"], spark)
    said = dict(x.split("\t") for x in capsys.readouterr().err.splitlines() if "\t" in x)
    assert calls == ["chunks", "matches"] and {k: int(v) for k, v in said.items()} == done.counters and set(shared._paths) == before


def test_scopes_nest(spark):
    before = set(shared._paths)
    with shared.scope():
        with shared.scope():
            a, b = shared.written(spark.range(3)), shared.outlives(shared.written(spark.range(4)))
        assert a._weftline_path not in shared._paths and b.count() == 4
    assert set(shared._paths) == before


def tables(index, spark):
    return [sorted(map(tuple, df.collect())) for df in (index.chunks(spark), index.keys(spark), index.reads(spark))]


def test_index_in_two_steps_equals_one(spark, tmp_path):
    rng = random.Random(3)
    r = sequences(spark, *["".join(rng.choice("ACGT") for _ in range(200)) + "ACGGTCAATCGGATTA" * 8 for _ in range(12)])
    p = SketchParams(7, 2, 10)
    one, two = store_index(r, "one", p, 3), stored.new_index(spark, "two", p, 3, str(tmp_path))
    assert two.batches(spark) == [] and two.chunks(spark).count() == 0
    assert two.append(r.where("read_id < 5")) and two.append(r.where("read_id >= 5"), batch=7)
    assert two.batches(spark) == [0, 7] and tables(two, spark) == tables(one, spark)
    assert not two.append(r.where("read_id >= 5"), batch=7) and tables(two, spark) == tables(one, spark)  # given again
    with pytest.raises(ValueError):
        two.append(r.where("read_id = 3"))
    # a batch that failed before its log was written is not seen, and is replaced when it comes again
    extra = sequences(spark, "ACGTTGCA" * 20).withColumn("read_id", F.lit(100).cast("long"))
    spark.sql("CREATE TABLE log_kept USING parquet AS SELECT * FROM two_log")
    two.append(extra, batch=8)
    spark.sql("INSERT OVERWRITE two_log SELECT * FROM log_kept")
    assert tables(two, spark) == tables(one, spark)
    assert two.append(extra.withColumn("name", F.lit("second try")), batch=8)
    assert [tuple(x) for x in two.reads(spark).where("read_id = 100").collect()] == [(100, "second try")]
    before = tables(two, spark)
    two.compact(spark)
    assert two.batches(spark) == [9] and tables(two, spark) == before and len(two.chunks(spark).inputFiles()) <= 3
    assert stored.open_index(spark, "two") == two
    for index in (one, two):
        index.drop(spark)
    spark.sql("DROP TABLE log_kept")
    with pytest.raises(ValueError):
        stored.open_index(spark, stored.new_index(spark, "none").name)


def test_index_is_not_shuffled(spark):
    r, p = near_copies(spark), SketchParams(7, 2, 10)
    kept = store_index(r, "kept2", p, buckets=3)
    kept.append(r.withColumn("read_id", F.col("read_id") + 50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(matching.query_matches(sketch.chunks(r, p), kept.chunks(spark)))
        assert joined.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in joined
        assert "Exchange hashpartitioning" not in plan(kept.keys(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept.drop(spark)


def test_stream_of_files_in_small_batches(spark, tmp_path):
    r, p = near_copies(spark), SketchParams(7, 2, 10)
    (tmp_path / "in").mkdir()
    for x in r.collect():
        (tmp_path / "in" / f"{x['name']}.fa").write_text(f">{x['name']} remark\n{x['sequence'][:70]}\n{x['sequence'][70:]}\n")
    kept = store_index(r, "kept3", p, buckets=3)
    start = lambda: query_mode.stream_fasta(spark, str(tmp_path / "in"), kept, str(tmp_path / "out"), str(tmp_path / "check"), files=1)
    got = lambda: sorted(map(tuple, query_mode.sunk(spark, str(tmp_path / "out"), tsv=True).collect()))
    assert start().awaitTermination(180)
    want = sorted(map(tuple, report.query_overlaps(r, r, p).collect()))
    assert got() == want and len(list((tmp_path / "out").glob("batch=*"))) == 3
    assert start().awaitTermination(180) and got() == want  # nothing new
    (tmp_path / "in" / "late.fa").write_text(f">late\n{r.first()['sequence']}\n")
    assert start().awaitTermination(180) and {x[0] for x in got()} == {"r0", "r1", "r2", "late"}
    kept.drop(spark)


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    r, p = near_copies(spark), SketchParams(7, 2, 10)
    rows = report.query_overlaps(r, r, p)
    for tsv in (False, True):
        sink = query_mode.batch_sink(str(tmp_path / f"out{tsv}"), tsv)
        for number in (0, 1, 1, 0):
            sink(rows.where(F.col("left") == f"r{number}"), number)
        assert sorted(map(tuple, query_mode.sunk(spark, str(tmp_path / f"out{tsv}"), tsv).collect())) == sorted(map(tuple, rows.where("left in ('r0', 'r1')").collect()))


def test_command_line_stream(spark, tmp_path, capsys):
    r = near_copies(spark).collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text("".join(f">{x['name']}\n{x['sequence']}\n" for x in r[:2]))
    before = set(shared._paths)
    cli.main(["stream", str(tmp_path / "out"), str(tmp_path / "in" / "a.fa"), str(tmp_path / "in"), "--k", "11", "--num-windows", "2", "--window-size", "10", "--max-files", "1"], spark)
    assert {(x["left"], x["right"]) for x in query_mode.sunk(spark, str(tmp_path / "out"), tsv=True).collect()} == {("r0", "r0"), ("r0", "r1"), ("r1", "r0"), ("r1", "r1")}
    said = capsys.readouterr().err
    assert "chain_matches\t4" in said and "distinct_chunks\t" in said and "singleton_chunks\t" in said and set(shared._paths) == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weftline_")]


def test_nameless_records_and_numbers_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">\nACGT\n> two words\nAC\n\nGT\n>\t\n\n>x\n")
    got = [(r["read_id"], r["name"], r["sequence"]) for r in sources.fasta_reads(spark, str(tmp_path / "a.fa")).orderBy("read_id").collect()]
    assert got == [(0, "", "ACGT"), (1, "two", "ACGT"), (2, "x", "")]
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 400))) for _ in range(500)]
    (tmp_path / "b.fa").write_text("".join(f">n{i}\n{s}\n" for i, s in enumerate(seqs)))
    quality = lambda s: ("@" + "@+!I"[len(s) % 4] * len(s))[: len(s)]
    (tmp_path / "b.fq").write_text("".join(f"@n{i}\n{s}\n+\n{quality(s)}\n" for i, s in enumerate(seqs)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")  # blocks end inside records
    try:
        for df in (sources.fasta_reads(spark, str(tmp_path / "b.fa")), sources.fastq_reads(spark, str(tmp_path / "b.fq"))):
            assert [(r["read_id"], r["name"], r["sequence"]) for r in df.orderBy("read_id").collect()] == [(i, f"n{i}", s) for i, s in enumerate(seqs)]
            assert df.rdd.getNumPartitions() > 5
            moved = [x for x in plan(df).split("\n") if "Exchange" in x and "Broadcast" not in x]
            assert all("body" not in x and "sequence" not in x for x in moved) and "SortMergeJoin" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keys_are_binary(spark):
    c = sketch.chunks(near_copies(spark), SketchParams(7, 3, 10))
    assert dict(c.dtypes)["key"] == "binary" and {len(r["key"]) for r in c.collect()} == {24}


def test_pruned_index_gives_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    r = sequences(spark, *["".join(rng.choice("ACGT") for _ in range(900)) for _ in range(60)])
    first = r.where("read_id < 2").withColumn("sequence", F.substring("sequence", 200, 300)).withColumn("raw_length", F.length("sequence").cast("long"))
    p = SketchParams(9, 2, 10)
    q = shared.written(sketch.chunks(first, p))
    keep = bloom.key_filter(q, 2)
    every, left = sketch.chunks(r, p), sketch.chunks(r, p, keep=keep)
    matching_rows = every.join(q.select("key").distinct(), "key", "left_semi")
    assert matching_rows.exceptAll(left).count() == 0 and left.exceptAll(every).count() == 0
    assert matching_rows.count() <= left.count() < matching_rows.count() + 0.05 * every.count()
    got = [sorted(map(tuple, report.query_overlaps(first, r, p, prune=x).collect())) for x in (False, True)]
    assert got[0] and got[0] == got[1]
    monkeypatch.setattr(bloom, "MOST_BITS", 64)
    assert bloom.key_filter(q, 2) is None and sorted(map(tuple, report.query_overlaps(first, r, p, prune=True).collect())) == got[0]
    assert bloom.key_filter(q.limit(0), 2).any() == False  # noqa: E712


def _odd_sequences():
    rng = random.Random(31)
    return ["".join(rng.choice("AC" if i % 2 else "ACGT") for _ in range(rng.randint(0, 120))) for i in range(20)] + ["A" * 60, "", "acgtACGT" * 6, "ACGTN" * 9, "é" + "ACGGT" * 9]


def _no_column_functions(monkeypatch):
    """The stages must come without the column functions, which cost ten times as much."""
    for name in ("masked", "hashed_kmers", "minima", "vectors", "emissions"):
        monkeypatch.setattr(sketch, name, None)


@pytest.mark.parametrize("stage", ["eligible", "masked", "kmers", "minima", "vectors", "emissions"])
@pytest.mark.parametrize("mask", ["none", "hpc"])
def test_stages_equal_column_functions(spark, monkeypatch, stage, mask):
    import hashlib

    seqs = _odd_sequences()
    p = SketchParams(3, 2, 4, mask, 1 << 20)
    df = sequences(spark, *seqs)
    md5 = lambda rows: hashlib.md5(",".join(rows).encode()).hexdigest()
    hexed = lambda v: "".join(f"{h:016x}" for h in v)
    m = sketch.masked(sketch.strands(df), mask)
    b = sketch.blocks(m, p)
    k = sketch.hashed_kmers(b, p)
    rows = {"eligible": sketch.eligible(m, p), "masked": m.where(F.size("syms") > 0), "kmers": k, "minima": sketch.minima(k, p), "vectors": sketch.vectors(sketch.minima(k, p), p), "emissions": sketch.emitted(df, p)}[stage]
    show = {
        "eligible": lambda r: (len(r["syms"]), len(r["syms"]) - p.span + 1),
        "masked": lambda r: (len(r["syms"]), "".join(x["s"] for x in r["syms"]), md5(f"{x['a']}-{x['z']}" for x in r["syms"])),
        "kmers": lambda r: (len(r["h"]), min(r["h"]), max(r["h"]), md5(map(str, r["h"]))),
        "minima": lambda r: (len(r["m"]), md5(f"{x['h']}:{x['p']}" for x in r["m"])),
        "vectors": lambda r: (len(r["v"]), md5(f"{hexed(x['v'])}:{x['a']}:{x['z']}" for x in r["v"])),
        "emissions": lambda r: (len(r["e"]), md5(f"{x['shift']}:{hexed(x['v'])}:{x['a']}:{x['z']}" for x in r["e"])),
    }[stage]
    want = sorted((r["read_id"], r["fw"], r["raw_length"], *show(r)) for r in rows.collect())
    _no_column_functions(monkeypatch)
    for piece, held in ((1 << 18, 1 << 17), (1, 5)):
        # held in this process too, as the tasks of Spark import the module anew
        monkeypatch.setattr(arrow_sketch, "PIECE", piece)
        monkeypatch.setattr(arrow_stages, "ROWS", held)
        chars, at = arrow_sketch.both_strands(*arrow_sketch._chars(pa.array(seqs), 0, len(seqs)))
        there, columns = arrow_stages.stage_of(chars, at, p, stage)
        got = zip(there.tolist(), *(x.to_pylist() if isinstance(x, pa.Array) else list(map(lambda v: v.item() if hasattr(v, "item") else v, x)) for x in columns), strict=True)
        n = len(seqs)
        assert want and sorted((i if i < n else 2 * n - 1 - i, i < n, len(seqs[i if i < n else 2 * n - 1 - i]), *x) for i, *x in got) == want
    assert sorted(map(tuple, arrow_stages.stages(df, p, stage).collect())) == want
    assert arrow_stages.stages(df.where("read_id < 0"), p, stage).count() == 0


def test_tandem_stage(spark):
    got = {r["read_id"]: r for r in arrow_stages.stages(sequences(spark, "TACACACGG", "", "A"), SketchParams(), "tandem").where("fw").collect()}
    import hashlib

    assert sorted(got) == [0, 2] and got[0]["n_symbols"] == 3
    assert got[0]["intervals"] == hashlib.md5(b"0-0,1-6,7-8").hexdigest() and got[0]["motifs"] == hashlib.md5(b"1,2,1").hexdigest()
    with pytest.raises(ValueError):
        arrow_stages.stages(sequences(spark, "ACGT"), SketchParams(mask="microsat"), "masked")


def test_packed_reads_equal_column_functions(spark):
    df = sequences(spark, *_odd_sequences()).union(spark.createDataFrame([(99, "r", None, None)], "read_id long, name string, raw_length long, sequence string"))
    b, size = twobit_encode(F.col("sequence")), F.col("raw_length").cast("int")
    want = df.select("read_id", b.alias("packed"), twobit_decode(b, size).alias("decoded"), twobit_slice(b, size, 7, 30).alias("piece")).collect()
    got = arrow_stages.unpacked_reads(arrow_stages.packed_reads(df), 7, 30).select("read_id", "packed", "decoded", "piece").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 26


def test_counted_keys_are_hashed_not_sorted(spark):
    """Chunks are joined with the counts of their keys without sorting them, and keys of one occurrence are left out before the pairs are made."""
    c = occurrences(spark, *[(f"k{i % 50 if i < 100 else i}", i, True, 0, 9, 50) for i in range(400)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ShuffledHashJoin" in plan(index.covered(c)) and "SortMergeJoin" not in plan(index.covered(c))
        assert "ShuffledHashJoin" in plan(matching.reads_with_match(c)) and "SortMergeJoin" not in plan(matching.reads_with_match(c))
        found = matching.matches(c)
        assert found.count() == 50 and index.covered(c).count() == 100 and matching.reads_with_match(c).count() == 100
        assert sum(spark.read.parquet(*{f.rsplit("/", 1)[0] for f in found.inputFiles()}).count() for _ in range(1)) == 100  # what was written for the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_of_a_batch_are_counted_where_its_chunks_lie(spark, monkeypatch):
    r, p = near_copies(spark), SketchParams(7, 2, 10)
    plans, table = [], stored.key_table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(stored, "key_table", lambda c: plans.append(plan(table(c))) or table(c))
    kept = store_index(r, "kept9", p, buckets=3)
    try:
        assert len(plans) == 1 and "Exchange hashpartitioning" not in plans[0] and "Bucketed: true" in plans[0]
        want = sorted(map(tuple, table(sketch.chunks(r, p)).collect()))
        assert want and sorted(map(tuple, kept.keys(spark).collect())) == want
        assert len(spark.table("kept9_keys").inputFiles()) <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept.drop(spark)


def test_matched_reads_are_sketched_again_only_if_unknown(spark, monkeypatch):
    """Ends of a bucket are known from its row of the key table; reads between them are looked up, and reads without a match are not found."""
    rng = random.Random(8)
    own = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(7)]
    # read 2 lies between 1 and 3 in every bucket that it is in; 0, 4 and 6 match nothing; 5 repeats its own keys only
    r, p = sequences(spark, own[0], own[1], own[1], own[1], own[2], own[3] + own[3], own[4], ""), SketchParams(15, 2, 10)
    calls, keys = [], matching.read_keys
    monkeypatch.setattr(matching, "read_keys", lambda reads, *more: calls.append((sorted(x["read_id"] for x in reads.collect()), len(more))) or keys(reads, *more))
    assert sorted(x["read_id"] for x in matching.matched_reads(r, p).collect()) == [1, 2, 3]
    assert calls == [(list(range(8)), 1), ([0, 2, 4, 5, 6, 7], 2)]  # the second time with a filter
    c = sketch.chunks(r, p)
    for j in (JoinParams(), JoinParams(min_coverage=4), JoinParams(max_coverage=2)):
        assert sorted(map(tuple, matching.matched_reads(r, p, j).collect())) == sorted(map(tuple, matching.reads_with_match(c, j).collect()))
    assert keys(r, p).columns == ["key", "read_id"] and sorted(map(tuple, keys(r, p).collect())) == sorted(map(tuple, c.select("key", "read_id").collect()))
    assert matching.matched_reads(r.where("read_id = 0"), p).count() == 0 == matching.matched_reads(r.limit(0), p).count()


def test_matches_sketch_and_shuffle_chunks_once(spark, monkeypatch):
    plans, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: plans.append(plan(df)) or write(df))
    c = sketch.chunks(near_copies(spark), SketchParams(7, 2, 10))
    assert matching.matches(c).count() > 0
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and plans[0].count("MapInArrow") == 1


def test_pairs_are_written_once_and_both_orders_share_a_shuffle(spark, monkeypatch):
    tables, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: tables.append(write(df)) or tables[-1])
    c = occurrences(spark, *[("k", i, True, 0, 9, 50) for i in range(9)])
    got = matching.pair_sets(c, size=4)
    assert [tuple(x) for x in tables[-1].where("left > right").collect()] == [] and tables[-1].count() == 36
    assert plan(got).count("Exchange") == 1
    assert {x["read_id"]: x["n_partners"] for x in got.collect()} == dict.fromkeys(range(9), 8)


def test_queries_of_a_kept_index_are_filtered_where_they_are_sketched(spark, monkeypatch):
    """Chunks with keys that no indexed read has do not leave the task; reads that are added later are found all the same."""
    r, p = near_copies(spark), SketchParams(7, 2, 10)
    filters, make = [], stored.chunks
    monkeypatch.setattr(stored, "chunks", lambda reads, p, keep=None: filters.append(keep) or make(reads, p, keep=keep))
    kept = store_index(r.where("read_id < 2"), "kept10", p)
    try:
        for new in ("read_id < 0", "read_id >= 2"):
            kept.append(r.where(new))
            there = r.where(f"read_id < 2 or {new}")
            want = sorted(map(tuple, report.query_overlaps(r, there, p).collect()))
            filters.clear()
            assert want and sorted(map(tuple, kept.overlaps(r).collect())) == want
            assert len(filters) == 1 and filters[0] is not None
            assert sketch.chunks(r, p, keep=filters[0]).count() <= sketch.chunks(r, p).count()
        assert len(kept._filters) == 1  # of the present state only
    finally:
        kept.drop(spark)


@pytest.mark.parametrize("setting", [{}, {"SIZE": 60, "MATCHES": 50, "LEAST": 4}, {"SIZE": 1000, "READS": 3, "MATCHES": 7, "LEAST": 1}])
def test_cells_equal_joined_matches(spark, monkeypatch, setting):
    """Blocks of all sizes, reads whose matches come in several parts, keys over several batches, and all bounds."""
    rng = random.Random(1)
    rows = {(f"{'hot' if i % 3 else i % 40}".encode(), i % 25, bool(i % 2), a := rng.randrange(90), a + rng.randrange(30), 500) for i in range(400)}
    c = spark.createDataFrame(sorted(rows), "key binary, read_id long, fw boolean, start long, end long, raw_length long")
    names = spark.range(30).selectExpr("id as read_id", "concat('r', id) as name")
    for name, value in setting.items():
        monkeypatch.setattr(cells, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    try:
        for j in (JoinParams(max_length_difference=20, chain_gap=3), JoinParams(max_coverage=60, min_coverage=3)):
            m, b = matching.matches(c, j), cells.packed(c, j, names)
            assert not setting or b.count() > 4
            chained = matching.chains(matching.normalised(m), j)
            assert same(cells.chains(b, j), chained) and same(cells.named_chains(b, j), report.named(chained, names, names))
            assert same(cells.read_pairs(b, j), matching.read_pairs(m)) and same(cells.pair_sets(b, j, 4), matching.pair_sets(c, j, 4))
            assert tuple(cells.totals(b, j).first()) == (matching.read_pairs(m).count(), chained.count(), m.count()) and m.count() > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cells.read_pairs(cells.packed(c.limit(0))).count() == 0 and tuple(cells.totals(cells.packed(c.limit(0))).first()) == (0, 0, 0)


def shuffled(spark, monkeypatch, query):
    """Exchanges of the plan of a registered query's result, and the rows of the tables that it writes, by 100 reads with one text and by 20."""
    out = []
    for n in (100, 20):
        same = "".join(random.Random(4).choice("ACGT") for _ in range(400))
        reads = spark.range(n).selectExpr("id as read_id", "concat('r', id) as name", f"{len(same)}L as raw_length", f"'{same}' as sequence")
        tables, write = [], shared.written
        for module in (cells, matching, report):
            monkeypatch.setattr(module, "written", lambda df: tables.append(write(df).count()) or write(df))  # noqa: B023
        monkeypatch.setattr(registry, "reads", lambda *a: reads)  # noqa: B023
        found = registry.QUERIES[query](spark, "")
        out.append((plan(found).count("Exchange hash"), max(tables), found.count()))
        monkeypatch.undo()
    return out


def test_counters_write_nothing_that_grows_with_pairs(spark, monkeypatch):
    (_, more, _), (_, less, _) = shuffled(spark, monkeypatch, "q_stats")
    assert more <= 5 * less + 5


@pytest.mark.parametrize("query", ["q_read_pairs", "q_chains", "q_overlaps"])
def test_pairs_are_made_without_a_shuffle(spark, monkeypatch, query):
    (shuffles, more, pairs), (_, less, few) = shuffled(spark, monkeypatch, query)
    assert shuffles == 0 and more <= 5 * less + 5 and pairs >= 24 * few


def test_pair_sets_shuffle_lists_of_partners(spark, monkeypatch):
    (shuffles, more, _), (_, less, _) = shuffled(spark, monkeypatch, "q_pair_sets")
    assert shuffles == 1 and more <= 5 * less + 5


def test_masked_matches_sketch_and_shuffle_chunks_once(spark, monkeypatch):
    rng = random.Random(6)
    base, tail, other = ("".join(rng.choice("ACGT") for _ in range(400)) for _ in range(3))
    # keys of the first half of read 0 are in a denied read, those that reads 3 and 4 share in no allowed one
    r, p, plans, write = sequences(spark, base, base, base[:200] + tail, other, other), SketchParams(7, 2, 10), [], matching.written
    c = sketch.chunks(r, p)
    allow, deny = (spark.createDataFrame([(i,) for i in x], "read_id long") for x in ((0, 0, 2, 999), (2, 2)))
    monkeypatch.setattr(matching, "written", lambda df: plans.append(plan(df)) or write(df))
    got = sorted(map(tuple, matching.masked_matches(r, allow, deny, p).collect()))
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1 and plans[0].count("Exchange hashpartitioning(key") == 1
    keys = lambda of: c.join(of, "read_id", "left_semi").select("key").distinct()
    assert got and got == sorted(map(tuple, matching.matches(index.masked_keys(c, keys(allow), keys(deny))).collect()))
    assert len(got) < matching.matches(c).count()


def test_appending_leaves_no_shuffle_files_and_no_index(spark, tmp_path, monkeypatch):
    r, seen, count = near_copies(spark), [], stored.key_table
    blocks = lambda: sum(1 for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x)
    monkeypatch.setattr(stored, "key_table", lambda c: seen.append(blocks()) or count(c))
    monkeypatch.setattr(registry, "reads", lambda *a: r)
    monkeypatch.setattr(registry, "_table", lambda *a: spark.createDataFrame([(0,)], "doc_id long"))
    before, left = set(shared._paths), blocks()
    got = registry.QUERIES["q_index_append"](spark, "")
    assert len(seen) == 2 and max(seen) <= left  # after the chunks of each batch are written
    assert len(set(shared._paths) - before) == 1  # the result
    want = index.key_table(sketch.chunks(r)).withColumn("key", F.lower(F.hex("key")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
