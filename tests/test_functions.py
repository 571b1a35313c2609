from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import header as H
from strandlake.functions import quality as Q
from strandlake.functions import sequence as S


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'long'}" for n, v in values.items())).select(column.alias("x")).first().x


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement("s"), s="acgtnX") == "NNACGT"
    assert one(spark, S.reverse_complement("s", keep_unknown=True), s="ACX") == "XGT"
    assert one(spark, S.reverse_complement("s"), s="") == ""
    assert one(spark, S.reverse_complement("s"), s=None) is None


def test_canonical(spark):
    assert one(spark, S.canonical("s"), s="TTTT").asDict() == {"sequence": "AAAA", "was_reversed": True}
    assert one(spark, S.canonical("s"), s="ACGT").was_reversed is False  # a palindrome


def test_hashes_by_hand(spark):
    assert one(spark, S.kmer_hash("s"), s="ACGT") == 0b00011011
    assert one(spark, S.kmer_hash("s"), s="ACNT") is None
    assert one(spark, S.kmer_hash("s"), s="T" * 31) == 4**31 - 1
    assert one(spark, S.hash_kmer("h", 4), h=27) == "ACGT"


def test_all_three_mers(spark):
    words = ["".join(w) for w in product("ACGT", repeat=3)]
    got = spark.createDataFrame([(w,) for w in words], "s string").select("s", S.canonical_hash("s").alias("c")).collect()
    value = {w: i for i, w in enumerate(words)}
    flip = str.maketrans("ACGT", "TGCA")
    for r in got:
        h, c = value[r.s], value[r.s.translate(flip)[::-1]]
        assert (r.c["hash"], r.c.is_forward) == (min(h, c), h <= c)


def test_hamming_and_entropy(spark):
    assert one(spark, S.hamming_within("a", "b", 2), a="ACGT", b="ACCTTT") == 1
    assert one(spark, S.hamming_within("a", "b", 0), a="ACGT", b="ACCT") is None
    assert one(spark, S.shannon_entropy("s"), s="ACGT") == 2.0
    assert one(spark, S.shannon_entropy("s"), s="") == 0.0
    assert one(spark, S.shannon_entropy("s"), s="AANN") == 0.5


def test_syncmers_brute_force(spark):
    text = "ACGGTCATTGCAGTACCGATGACGTTAGCATCGGATTACAGNACGATCGATTACGATCAGCATCGA"
    flip = str.maketrans("ACGT", "TGCA")

    def canon(k):
        h = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
        return min(h(k), h(k.translate(flip)[::-1]))

    want = []
    for i in range(len(text) - 20):
        k = text[i : i + 21]
        inner = [k[j : j + 10] for j in range(12)]
        if "N" not in k and inner.index(min(inner)) == 0:
            want.append((canon(k), i))
    got = one(spark, S.syncmers("s"), s=text)
    assert [(x["hash"], x.pos) for x in got] == want
    best = one(spark, S.min_syncmer("s"), s=text)
    assert (best["hash"], best.pos) == min(want)
    assert one(spark, S.hint_byte("s"), s="ACGT") == 255


def test_numbers(spark):
    for v, z in ((0, 0), (-1, 1), (1, 2), (-64, 127), (64, 128)):
        assert one(spark, S.zigzag("v"), v=v) == z
        assert one(spark, S.unzigzag("v"), v=z) == v
    for v, n in ((0, 1), (127, 1), (128, 2), (1 << 35, 6)):
        assert one(spark, S.varint_size("v"), v=v) == n
        assert len(one(spark, S.varint("v"), v=v)) == n


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=40), min_size=1, max_size=20))
def test_packing_round_trip(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", S.unpack_bases(S.pack_bases("s")).alias("p"), S.mask_n("s").alias("m")).select("s", "p", S.unmask_n("m.bases", "m.positions").alias("u")).collect()
    assert all(r.s == r.p == r.u for r in rows)


EXPECTED = {
    "illumina_bin": lambda q: 6 if q < 20 else 15 if q < 30 else 22 if q < 40 else 27 if q < 50 else 33 if q < 60 else 37 if q < 70 else 40,
    "illumina_bin_std": lambda q: 0 if q < 2 else 6 if q < 10 else 15 if q < 20 else 22 if q < 25 else 27 if q < 30 else 33 if q < 35 else 37 if q < 40 else 40,
    "four_level": lambda q: 6 if q < 10 else 15 if q < 20 else 25 if q < 30 else 37,
    "binary": lambda q: 10 if q < 20 else 40,
}


def test_quality_tables(spark):
    text = "".join(chr(33 + q) for q in range(94))
    for mode, value in EXPECTED.items():
        assert one(spark, Q.quantize("q", mode), q=text) == "".join(chr(33 + value(q)) for q in range(94))
    # the two steps of the default mode, taken one after another
    two = Q.bin_values(Q.bin_codes(Q.quantize_by_decade("q"), "illumina8"), "illumina8")
    assert one(spark, two, q=text) == one(spark, Q.quantize("q", "illumina_bin"), q=text)


def test_run_lengths(spark):
    got = one(spark, Q.run_lengths("q"), q="FF#F,FFF")
    assert [(r.run, r.breaker) for r in got] == [(2, "#"), (1, ","), (3, None)]


def test_headers(spark):
    sra = "@ERR3239334.100 A00296:43:HCLHLDSXX:4:2174:25834:28823/1"
    p = one(spark, H.parse_sra("h"), h=sra)
    assert (p.read_num, p.combo, p.lane, p.tile, p.x, p.y, p.pair) == (100, "A00296:43:HCLHLDSXX", 4, 2174, 25834, 28823, "/1")
    umi = "@SIM:1:FCX:1:2106:15337:1063:GATCTGTACGTC 1:N:0:ATCACG"
    p = one(spark, H.parse_casava("h"), h=umi)
    assert (p.umi, p.comment) == (":GATCTGTACGTC", "1:N:0:ATCACG")
    for h, kind, whole in ((sra, "sra", True), (sra[:-2], "sra", True), (umi, "casava", True), ("@READ_1 some comment", "raw", False), (umi.replace(":2106:", ":02106:"), "casava", False), (umi.replace(":15337:", ":99999:"), "casava", False)):
        assert one(spark, H.dialect("h"), h=h) == kind
        assert one(spark, H.lossless("h"), h=h) is whole
    assert one(spark, H.template("h"), h="@INSTRUMENT:123:FLOWCELL:1:2101:10000:1000").asDict() == {"prefix": "@INSTRUMENT:123:FLOWCELL:1:2101", "x": 10000, "y": 1000, "comment": None}


def test_pair_patterns(spark):
    for a, b, n in (("@x/1", "@x/2", 1), ("@x 5", "@x 5", 2), ("@x 1:N:0", "@x 2:N:0", 3), ("@x", "@y", 0)):
        assert one(spark, H.pair_pattern("a", "b"), a=a, b=b) == n


def test_token_codes(spark):
    got = one(spark, H.token_codes("a", "b"), a="@r12:7:007", b="@r10:7:9")
    assert [(t.kind, t.value) for t in got] == [("match", ""), ("match", ""), ("delta", "2"), ("match", ""), ("match", ""), ("match", ""), ("number", "007")]


def test_let_is_null_safe(spark):
    assert one(spark, S.mismatches("a", "b"), a=None, b="A") is None
    assert one(spark, F.size(S.mismatches("a", "b")), a="", b="A") == 0
