import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from annealix.functions import bases, binding, duplex
from annealix.operators import assays as qa
from annealix.operators import bindings, joins, masking, results, seeds
from annealix.plans.config import SearchConfig
from annealix.plans.search import find_bindings, search
from annealix.sources import readers, writers
from annealix.streaming.arrivals import watch

AMPLICON = "TTCCCCTTTGGAGGCATCCAAGCGATGGGCTTTCAGGACAGGTGTACCTCCCAAGAATGTTGAGTATACAGAAGGGGAGGAAGCCAAAACATGCTACAATATAAGTGTAACGGATCCCTCTGGAAAATCCTTGCTGTTGGATCCTCC"
F_OLIGO, R_OLIGO, P_OLIGO = "TTCCCCTTTGGAGGCATC", "GGAGGATCCAACAGCAAGG", "CGATGGGCTTTCAGGACAGGTGT"
GOLDEN = [(F_OLIGO, -135.5, -0.382533, -16.8574, 57.1794), (R_OLIGO, -146.5, -0.414653, -17.8955, 58.0610), (P_OLIGO, -180.2, -0.506923, -22.9778, 63.9328)]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def target(spark, *seqs):
    return spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(seqs)], "target_id long, defline string, seq string")


def assay(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "assay_id long, name string, forward string, reverse string, probe string")


@pytest.mark.parametrize(("oligo", "dh", "ds", "dg", "tm"), GOLDEN)
def test_golden_duplexes(spark, oligo, dh, ds, dg, tm):
    b = binding.bind_many([oligo], [rc(oligo)], [9e-7])[0]
    assert (round(b.dh, 4), round(b.ds, 6), round(b.dg, 4), round(b.tm, 4)) == (dh, ds, dg, tm)
    assert binding.clamps(b, oligo, rc(oligo)) == (len(oligo), len(oligo))
    assert binding.counts(b, oligo, rc(oligo)) == (0, 0, 0)
    x = duplex.duplex(F.lit(oligo))
    row = spark.range(1).select(*[v.alias(k) for k, v in x.items()]).first()
    assert (round(row.dh, 4), round(row.ds, 6), round(row.dg, 4), round(row.tm, 4)) == (dh, ds, dg, tm)


def test_binding_properties():
    r = random.Random(5)
    o = "".join(r.choice("ACGT") for _ in range(20))
    last = -1.0
    for salt in (0.01, 0.05, 0.2):
        tm = binding.bind_many([o], [rc(o)], [9e-7], binding.Conditions(salt=salt))[0].tm
        assert tm > last
        last = tm
    assert binding.bind_many([o], [rc(o)], [1e-6])[0].tm > binding.bind_many([o], [rc(o)], [1e-7])[0].tm
    t = list(rc(o))
    t[10] = "A" if t[10] != "A" else "C"
    b = binding.bind_many([o], ["".join(t)], [9e-7])[0]
    assert binding.counts(b, o, "".join(t))[:2] == (1, 0) and b.tm < last
    gap = rc(o)[:10] + rc(o)[11:]
    b = binding.bind_many([o], [gap], [9e-7])[0]
    assert binding.counts(b, o, gap)[1] == 1
    assert binding.bind_many(["AAAAAAA"], ["AAAAAAAAAA"], [9e-7])[0] is None
    pic = binding.picture(binding.bind_many([o], [rc(o)], [9e-7])[0], o, rc(o)).split("\n")
    assert pic[0] == f"5'-{o}-3'" and pic[1].strip() == "|" * 20 and pic[2] == f"3'-{rc(o)[::-1]}-5'"


def test_batches_equal_single_windows():
    r = random.Random(9)
    os_ = ["".join(r.choice("ACGT") for _ in range(r.randint(12, 22))) for _ in range(30)]
    ts = [rc(o)[r.randint(0, 3) :] + "".join(r.choice("ACGTN") for _ in range(r.randint(0, 6))) for o in os_]
    many = binding.bind_many(os_, ts, [9e-7] * 30)
    for o, t, b in zip(os_, ts, many):
        one = binding.bind_many([o], [t], [9e-7])[0]
        assert (b is None) == (one is None) and (b is None or math.isclose(b.dg, one.dg))


def test_inosine_and_degenerate_targets():
    o = "ACGTACGTACGTAC"
    t = rc(o)[:5] + "N" + rc(o)[6:]
    b = binding.bind_many([o], [t], [9e-7])[0]
    assert binding.counts(b, o, t) == (0, 0, 1)
    i = o[:6] + "I" + o[7:]
    b = binding.bind_many([i], [rc(o)], [9e-7])[0]
    assert binding.counts(b, i, rc(o))[0] == 0
    assert binding.complementary("I", "T") and binding.complementary("R", "Y") and not binding.complementary("A", "G")


def test_hairpin():
    pin = binding.hairpin("GGGGCCTTTTGGCCCC")
    assert pin is not None and pin[2] > 50
    assert binding.hairpin("AAAAAAAAAAAA") is None


def test_worked_example(spark):
    m = search(assay(spark, ("gm", F_OLIGO, R_OLIGO, P_OLIGO)), target(spark, AMPLICON, rc(AMPLICON), "ACGT" * 50), SearchConfig(min_primer_tm=50, min_probe_tm=50)).orderBy("target_id").collect()
    assert [(x.target_id, x.start, x.stop) for x in m] == [(0, 0, 146), (1, 0, 146)]
    assert m[0].sequence == m[1].sequence == AMPLICON
    assert (m[0].primer_strand, m[1].primer_strand) == ("+", "-")
    assert (m[0].p_loc_5, m[0].p_loc_3) == (22, 44)
    assert [round(100 * m[0][c], 4) for c in ("f_gc", "r_gc", "p_gc")] == [55.5556, 57.8947, 56.5217]
    assert m[0].f_rules == m[0].r_rules == "MULTI_5_GC, NO_POLY_RUNS"
    assert round(m[0].f_tm, 4) == 57.1794 and m[0].f_num_mm == 0


def test_matches_do_not_depend_on_chunks(spark):
    r = random.Random(3)
    seq = "".join(r.choice("ACGT") for _ in range(300)) + AMPLICON + "".join(r.choice("ACGT") for _ in range(200))
    a, t = assay(spark, ("gm", F_OLIGO, R_OLIGO, P_OLIGO)), target(spark, seq)
    whole = None
    for size in (10_000, 150, 64):
        m = sorted((x.start, x.stop, x.p_loc_5, round(x.min_tm, 6)) for x in search(a, t, SearchConfig(min_primer_tm=45, min_probe_tm=45, max_target_len=size)).collect())
        whole = whole or m
        assert m == whole and (300, 446) in {x[:2] for x in m}


def test_degenerate_assay(spark):
    f = "Y" + F_OLIGO[1:]
    m = search(assay(spark, ("d", f, R_OLIGO, None)), target(spark, AMPLICON), SearchConfig(min_primer_tm=55, max_mismatch=0)).collect()
    assert [x.f_oligo for x in m] == [F_OLIGO]
    assert round(m[0].f_tm, 4) == round(binding.bind_many([F_OLIGO], [rc(F_OLIGO)], [4.5e-7])[0].tm, 4)


def test_padlock_and_probe(spark):
    left, right = AMPLICON[30:50], AMPLICON[50:70]
    t = target(spark, AMPLICON, AMPLICON[:50] + "G" + AMPLICON[50:], rc(AMPLICON))
    a = assay(spark, ("p", left, right, None))
    got = search(a, t, SearchConfig(assay="PADLOCK", min_probe_tm=45)).collect()
    assert sorted((x.target_id, x.start, x.stop, x.p_strand) for x in got) == [(0, 30, 69, "-"), (2, 77, 116, "+")]
    gaps = search(a, t, SearchConfig(assay="MIPS", min_probe_tm=45, max_len=1)).collect()
    assert sorted((x.target_id, x.gap) for x in gaps) == [(0, 0), (1, 1), (2, 0)]
    probes = search(assay(spark, ("q", None, None, P_OLIGO)), t, SearchConfig(assay="PROBE", min_probe_tm=55)).collect()
    assert sorted((x.target_id, x.p_strand) for x in probes) == [(0, "-"), (1, "-"), (2, "+")]


def test_overhanging_primer_is_padded(spark):
    t = AMPLICON[2:]
    m = search(assay(spark, ("o", F_OLIGO, R_OLIGO, None)), target(spark, t), SearchConfig(min_primer_tm=40)).collect()
    assert [(x.start, x.stop) for x in m] == [(-2, 144)]
    assert m[0].sequence == "--" + t and m[0].f_num_mm == 2


def test_single_primer_and_nested_pairs(spark):
    sites = [(0, 0, 0, "F", "-", 5, 10), (0, 0, 0, "F", "+", 40, 45), (0, 0, 0, "R", "+", 60, 65), (0, 0, 0, "R", "-", 20, 25)]
    b = spark.createDataFrame(sites, "assay_id long, degen_id long, target_id long, role string, strand string, loc_5 long, loc_3 long")
    got = {(x.f_loc_5, x.r_loc_3) for x in joins.pcr_pairs(b, 61).collect()}
    assert got == {(5, 45), (5, 65), (20, 45), (20, 65)}
    assert {(x.f_loc_5, x.r_loc_3) for x in joins.pcr_pairs(b, 61, single_primer=False).collect()} == {(5, 65), (20, 45)}
    assert {(x.f_loc_5, x.r_loc_3) for x in joins.pcr_pairs(b, 60).collect()} == {(5, 45), (20, 45), (20, 65)}


def test_range_join_is_exactly_once(spark):
    r = random.Random(2)
    sites = [(0, 0, 0, r.choice("FR"), r.choice("-+"), s, s + 9) for s in [r.randint(-20, 400) for _ in range(120)]]
    b = spark.createDataFrame(sites, "assay_id long, degen_id long, target_id long, role string, strand string, loc_5 long, loc_3 long")
    want = sorted((f[5], q[6]) for f in sites for q in sites if f[4] == "-" and q[4] == "+" and f[6] < q[5] and q[6] - f[5] + 1 <= 70)
    assert sorted((x.f_loc_5, x.r_loc_3) for x in joins.pcr_pairs(b, 70).collect()) == want


def test_expansion_and_rules(spark):
    row = spark.range(1).select(bases.expand(F.lit("TYAN")).alias("e"), bases.degeneracy(F.lit("TYAN")).alias("d"), bases.degeneracy(F.lit("TXA")).alias("x"), bases.revcomp(F.lit("ACGTRYN")).alias("r"), bases.clean_sequence(F.lit("ac gu-*x\n")).alias("c")).first()
    assert row.e[:4] == ["TTAA", "TCAA", "TTAT", "TCAT"] and len(row.e) == row.d == 8 and row.x is None
    assert row.r == "NRYACGT" and row.c == "ACGTN"
    rules = spark.createDataFrame([("GGAGGATCCAACAGCAAGG",), ("ACGTNACG",), ("ACACACACAGTGTGTGTACA",), ("ATATATATCCC",), ("AAAAT",)], "s string").select(bases.primer_report(F.col("s")).alias("r")).collect()
    assert [x.r for x in rules] == ["MULTI_5_GC, NO_POLY_RUNS", "BAD_BASE", "PCR_VALID", "POLY_3_GC", "NO_3_T"]


def test_multiplex_keeps_one_of_equal_assays(spark):
    a = assay(spark, ("a", "AAAA", "CCCC", None), ("b", "GGGG", "TTTT", None))
    pairs = qa.multiplex_pcr(a)
    assert {x.name for x in pairs.collect()} == {"a", "b", "a(F)/b(R)", "b(F)/a(R)", "a(F)/b(F)", "a(R)/b(R)"}
    twice = a.unionByName(a.selectExpr("assay_id + 9 as assay_id", "name", "reverse as forward", "forward as reverse", "probe"))
    assert sorted(x.assay_id for x in qa.distinct_assays(twice).collect()) == [0, 1]


def test_seeds_skip_odd_bases(spark):
    o = spark.createDataFrame([("ACGTACGTIACGTACG",)], "oligo string")
    hits = seeds.seed_hits(o, target(spark, "ACGTACGTAACGTACG", "ACG"), 7)
    assert {(x.q, x.t) for x in hits.where("target_id = 0 and strand = '-'").collect()} >= {(0, 0), (1, 1), (9, 9)}
    assert hits.where("q between 2 and 8 and strand = '-'").count() == 0
    assert hits.where("target_id = 1").count() == 0


def test_perfect_sites_near_each_other(spark):
    """Two sites four bases apart are both found, on each strand; a site with a mismatch or an odd base is not."""
    oligo = "ACGGACGGACGGACGGAC"
    long = "TTTCA" + oligo + "GGAC" + "TTGAT"
    wrong = oligo[:9] + "T" + oligo[10:]
    t = target(spark, long, rc(long), wrong, oligo[:9] + "N" + oligo[10:], "ACG", oligo)
    o = spark.createDataFrame([(oligo,), ("ACG",)], "oligo string")
    win = seeds.perfect_windows(o, t, 18).withColumn("ct", F.lit(9e-7))
    got = bindings.unique(bindings.within(bindings.bind(win), max_mismatch=0, max_gap=0), "oligo", "target_id").collect()
    n = len(long)
    want = [(0, "-", 5, 22), (0, "-", 9, 26), (1, "+", n - 27, n - 10), (1, "+", n - 23, n - 6), (5, "-", 0, 17)]
    assert sorted((x.target_id, x.strand, x.loc_5, x.loc_3) for x in got) == want


def test_validation():
    assert SearchConfig().validate().max_len == 2000
    for bad in ({"salt": 1.0}, {"primer_ct": 0}, {"word_length": 9}, {"assay": "X"}, {"min_primer_tm": 80, "max_primer_tm": 60}, {"target_strand": "x"}):
        with pytest.raises(ValueError):
            SearchConfig(**bad).validate()


def test_thresholds_and_small_functions(spark):
    with pytest.raises(ValueError):
        SearchConfig().with_thresholds(True, False)
    with pytest.raises(ValueError):
        SearchConfig(min_primer_tm=50).with_thresholds(True, True)
    assert SearchConfig(min_primer_tm=50).with_thresholds(True, False).min_probe_tm == 0
    assert SearchConfig(assay="PROBE", min_primer_tm=50).with_thresholds(False, True).min_probe_tm == 50
    assert SearchConfig(assay="MIPS", min_primer_tm=50, min_probe_tm=40).with_thresholds(True, False).min_probe_tm == 40
    assert spark.range(1).select(duplex.effective_concentration(F.lit(2.0), F.lit(6.0))).first()[0] == 5.0
    t = spark.createDataFrame([(1, 1, 1, 0, 9, 50.0, 3, 5), (1, 1, 1, 0, 9, 60.0, 4, 6), (1, 1, 1, 1, 9, 10.0, 4, 6)], "assay_id long, degen_id long, target_id long, start long, stop long, p_tm double, p_loc_5 long, p_loc_3 long")
    assert sorted(x.p_tm for x in results.best_probe(t).collect()) == [10.0, 60.0]


def test_masking(spark):
    s = F.lit("AACCGGTTAACC")
    row = spark.range(1).select(masking.mask_primers(s, F.lit(3), F.lit(2)).alias("m"), masking.replace_ends(s, F.lit("NNN"), F.lit("TT")).alias("r"), masking.mask_ranges(s, F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("stop")))).alias("p")).first()
    assert (row.m, row.r, row.p) == ("aacCGGTTAAcc", "NNNCGGTTAATT", "AAccgGTTAACC")


def test_edge_filter_and_gaps(spark):
    f = spark.createDataFrame([(1, 5, 9), (1, 7, 20), (1, 30, 40), (1, 21, 22)], "target_id long, f_start long, f_stop long")
    assert sorted((x.gap_start, x.gap_stop) for x in joins.feature_gaps(f).collect()) == [(0, 4), (23, 29)]
    m = spark.createDataFrame([(0, 50, 100, True, False), (0, 99, 100, True, False), (0, 50, 100, False, True)], "start long, stop long, chunk_length long, is_first boolean, is_last boolean")
    assert results.edge_filter(m).count() == 1


GBK = """LOCUS       AB1 20 bp DNA
DEFINITION  x
ACCESSION   AB1 AB2
SOURCE      Some virus
FEATURES             Location/Qualifiers
     source          1..20
                     /organism="Some virus"
     gene            2..10
                     /gene="GP"
     CDS             2..10
                     /product="GP protein, a/b
                     long"
                     /protein_id="P1"
     tRNA            complement(join(12..13,15..18))
                     /product="tRNA-x"
     misc_feature    <1..>20
                     /note="n"
BASE COUNT        5 a      5 c      5 g      5 t
ORIGIN
        1 acgtacgtac gtacgtacgt
//
LOCUS       EMPTY 0 bp DNA
DEFINITION  none
//
"""
EMBL = """ID   X1; SV 1; linear; DNA; 12 BP.
AC   X1; X2;
OS   Other virus
FT   gene            3..8
FT                   /gene="L"
FT   CDS             3..8
FT                   /product="polymerase"
SQ   Sequence 12 BP; 3 A; 3 C; 3 G; 3 T; 0 other;
     acgtacgtac gt                                                          12
//
"""


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x>y\nacgu\nAC-GT*\n\n>two\r\nNNN\r\nAC\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nTTTT\n")
    got = [(x.defline, x.seq) for x in readers.read_targets(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [("one x>y", "ACGTACGT"), ("two", "NNNAC")]
    assert readers.read_fasta(spark, str(tmp_path / "*.fa*")).count() == 3
    (tmp_path / "c.fq").write_text("@r1 d\nACGT\n+\n@@@@\n@r2\nTT\n+r2\n++\n")
    assert [(x.defline, x.seq) for x in readers.read_targets(spark, str(tmp_path / "c.fq")).orderBy("target_id").collect()] == [("r1 d", "ACGT"), ("r2", "TT")]
    (tmp_path / "d.gb").write_text(GBK)
    g = readers.read_targets(spark, str(tmp_path / "d.gb"))
    (row,) = g.collect()
    assert (row.defline, row.seq) == ("AB1 Some virus", "ACGT" * 5)
    f = {(x.type, x.f_start, x.f_stop, x.strand): x for x in readers.features_of(g).collect()}
    assert set(f) == {("GENE", 1, 9, "+"), ("tRNA", 11, 17, "-"), ("IMP", 0, 19, "+")}
    gene = f["GENE", 1, 9, "+"]
    assert (gene.locus, gene.product, gene.ids) == ("GP", "GP protein, a/b long", ["P1"])
    assert [(s.start, s.stop) for s in f["tRNA", 11, 17, "-"].segments] == [(11, 12), (14, 17)]
    (tmp_path / "e.embl").write_text(EMBL)
    (row,) = readers.read_targets(spark, str(tmp_path / "e.embl")).collect()
    assert (row.defline, row.seq, row.features[0].product, len(row.features)) == ("X1 Other virus", "ACGTACGTACGT", "polymerase", 1)
    (tmp_path / "bad.embl").write_text(EMBL.replace("3 A", "4 A"))
    with pytest.raises(Exception, match="differ"):
        readers.read_targets(spark, str(tmp_path / "bad.embl")).collect()


def test_locations():
    assert readers.parse_location("5") == (4, 4, False, [(4, 4)])
    assert readers.parse_location("complement(join(10..12, 1..3))") == (0, 11, True, [(0, 2), (9, 11)])
    assert readers.parse_location("order(<1..2,>5..9)") == (0, 8, False, [(0, 1), (4, 8)])
    with pytest.raises(ValueError):
        readers.parse_location("x")
    with pytest.raises(ValueError):
        readers.sniff(" \n")


def test_assay_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\nq acgt\n\np ACGT  CCCC # tail\nt\tAAAA CCCC GGGG\n")
    rows = readers.read_assays(spark, str(tmp_path / "a.txt")).orderBy("assay_id").collect()
    assert [(x.assay_id, x.name, x.forward, x.reverse, x.probe) for x in rows] == [(0, "q", None, None, "ACGT"), (1, "p", "ACGT", "CCCC", None), (2, "t", "AAAA", "CCCC", "GGGG")]
    forced = readers.read_assays(spark, str(tmp_path / "a.txt"), force_probe=True).orderBy("assay_id").collect()
    assert [(x.name, x.probe) for x in forced] == [("q", "ACGT"), ("p_F", "ACGT"), ("p_R", "CCCC"), ("t_F", "AAAA"), ("t_R", "CCCC"), ("t_P", "GGGG")]
    (tmp_path / "b.txt").write_text("only\n")
    with pytest.raises(Exception, match="2 to 4 columns"):
        readers.read_assays(spark, str(tmp_path / "b.txt")).collect()


def test_reports(spark, tmp_path):
    a, t = assay(spark, ("g m", F_OLIGO, R_OLIGO, P_OLIGO), ("none", "ACGTTGCAACGGTTA", "TTGACCATGACCAGT", None)), target(spark, AMPLICON, "ACGT" * 30)
    m = search(a, t, SearchConfig(min_primer_tm=50, min_probe_tm=50)).cache()
    assert writers.fasta_lines(m, with_assay=True).first().value == f">t0 g m\n{AMPLICON}"
    text = writers.report_lines(m, prefix="# ").first().value
    assert "forward tm = 57.17" in text and "# 5'-TTCC" in text and "probe mismatches = 0" in text and "range = 0 .. 146" in text
    assert writers.sif_lines(m).first().value == "g_m binds t0"
    assert [x.value for x in writers.atr_lines(a, m).collect()] == ["FunctionalCatagory", "g_m = parent", "none = parent", "t0 = child"]
    assert [x.defline for x in results.unmatched_targets(t, m).collect()] == ["t1"]
    assert [x.name for x in results.unmatched_assays(a, m).collect()] == ["none"]
    assert {x.name: x.n_targets for x in results.assay_summary(a, m).collect()} == {"g m": 1, "none": 0}
    writers.write_per_assay(m.select("name", "defline"), str(tmp_path / "per"))
    assert spark.read.parquet(str(tmp_path / "per")).count() == 1
    f = spark.createDataFrame([(0, 100, 5000, "GENE", "+", ["i"], "GP", None, "p", None), (0, 500, 600, "RNA", "-", None, None, "L", None, "x\ny")], "target_id long, f_start long, f_stop long, type string, strand string, ids array<string>, locus string, locus_tag string, product string, note string")
    assert [x.value for x in writers.annotation_lines(joins.annotation_overlap(m, f)).collect()] == ["GENE\t[100 .. 5000] +\ti\tGP\tp\t"]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(f">a\n{AMPLICON[:70]}\n{AMPLICON[70:]}\n>b\nACGTACGT\n")
    q = watch(spark, str(tmp_path / "in"), assay(spark, ("gm", F_OLIGO, R_OLIGO, None)), str(tmp_path / "out"), str(tmp_path / "ck"), SearchConfig(min_primer_tm=50))
    q.awaitTermination(120)
    assert [x.defline for x in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_masked_and_replaced_sites(spark):
    a, t = assay(spark, ("gm", F_OLIGO, R_OLIGO, P_OLIGO)), target(spark, "G" + AMPLICON[1:], rc(AMPLICON))
    n, m = len(F_OLIGO), len(R_OLIGO)
    got = {x.target_id: x.sequence for x in search(a, t, SearchConfig(min_primer_tm=45, min_probe_tm=50, mask_primers=True, mask_probe=True)).collect()}
    inner = AMPLICON[n:22] + P_OLIGO.lower() + AMPLICON[45:-m]
    assert got[1] == F_OLIGO.lower() + inner + rc(R_OLIGO).lower()
    assert got[0] == "G" + F_OLIGO[1:].lower() + inner + rc(R_OLIGO).lower()
    got = {x.target_id: x.sequence for x in search(a, t, SearchConfig(min_primer_tm=45, min_probe_tm=50, replace_primers=True)).collect()}
    assert got == {0: AMPLICON, 1: AMPLICON}


def test_roles_self_structure_and_iteration(spark):
    a, t = assay(spark, ("gm", F_OLIGO, R_OLIGO, P_OLIGO)), target(spark, AMPLICON, rc(AMPLICON))
    rows = search(a, t, SearchConfig(min_primer_tm=50, min_probe_tm=50, self_structure=True)).collect()
    assert {(x.f_oligo, x.r_oligo) for x in rows} == {(F_OLIGO, R_OLIGO)}
    assert all(x.r_hairpin_tm > 40 and x.dimer_tm >= 0 and x.p_homodimer_tm >= 0 for x in rows)
    again = search(a, t, SearchConfig(min_primer_tm=50, min_probe_tm=50, dinkelbach=True)).collect()
    assert {(x.start, x.stop) for x in again} == {(0, 146)}


def test_command_line(spark, tmp_path):
    from annealix.__main__ import main

    (tmp_path / "a.txt").write_text(f"gm {F_OLIGO} {R_OLIGO} {P_OLIGO}\nnone ACGTTGCAACGGTTA TTGACCATGACCAGT\n")
    (tmp_path / "t.fa").write_text(f">one\n{AMPLICON}\n>two\nACGTACGTACGT\n")
    read = lambda k: sorted(x.value for x in spark.read.text(f"{tmp_path}/{k}").collect())
    base = ["-i", f"{tmp_path}/a.txt", "-d", f"{tmp_path}/t.fa", "-e", "50", "-E", "50"]
    main([*base, "-o", f"{tmp_path}/0", "-S", "T", "--dump-query", "T"])
    assert "reverse hairpin tm" in " ".join(read("0/text")) and spark.read.parquet(f"{tmp_path}/0/summary").count() == 2
    main([*base, "-o", f"{tmp_path}/1", "-m", "1", "-L", "T", "-n", "T"])
    assert ">one gm" in read("1/text")
    main([*base, "-o", f"{tmp_path}/2", "-m", "2"])
    assert read("2/sif") == ["gm binds one"]
    main([*base, "-o", f"{tmp_path}/3", "-m", "3"])
    assert read("3/targets") == ["two"]
    main([*base, "-o", f"{tmp_path}/4", "-m", "4"])
    assert read("4/assays_without_match") == ["none"]


def test_no_rows(spark):
    a, t = assay(spark, ("gm", F_OLIGO, R_OLIGO, P_OLIGO)), target(spark, AMPLICON)
    assert search(a, t.limit(0)).count() == 0
    assert search(a.limit(0), t).count() == 0
    assert find_bindings(qa.variants(a), target(spark, ""), SearchConfig()).count() == 0
    assert bindings.self_structure(spark.createDataFrame([(None,), (F_OLIGO,)], "oligo string"), 9e-7).count() == 1
