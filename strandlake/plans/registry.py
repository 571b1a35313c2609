"""Named queries over reads derived from the driver's ``orders`` table, each with an equivalent SQL text.

Numbers are widened to LONG and doubles rounded, so that both engines give one text for a value.
"""

from __future__ import annotations

import functools
import sys
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import header as H
from ..functions import quality as Q
from ..functions import sequence as S
from ..operators import assembly, clusters, consensus, delta, entropy, kmers, pairs, reorder
from ..sources import archive, fastq, reads as R
from ..session import keep, shared_dir
from . import api, chain

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

_WITH = f"WITH reads AS ({R.READS_SQL}), mutated AS ({R.MUTATED_SQL})"
_BASES = """, bases AS (SELECT read_idx, CAST(i - 1 AS BIGINT) AS pos, substr(sequence, i, 1) AS base, CAST(ascii(substr(quality, i, 1)) - 33 AS BIGINT) AS phred
  FROM reads, unnest(range(1, length(sequence) + 1)) t(i))"""
_CONTEXT = _BASES + """, context AS (SELECT *, lag(phred, 1, 0) OVER w AS q1, lag(phred, 2, 0) OVER w AS q2, lag(base, 1, 'N') OVER w AS b1, lag(base, 2, 'N') OVER w AS b2,
  lead(base, 1, 'N') OVER w AS n1 FROM bases WINDOW w AS (PARTITION BY read_idx ORDER BY pos))"""


def tidy(df: DataFrame) -> DataFrame:
    def one(name, kind):
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("long").alias(name)
        if kind == "double":
            return F.round(name, 6).alias(name)
        return F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def _add(name: str, sql: str | None, build, mutated: bool = False, extra: str = "") -> None:
    """Register ``build(reads)``; ``sql`` follows the common table expressions."""
    _QUERIES[name] = lambda spark, sf_dir: tidy(build(R.derived_reads(spark, sf_dir, mutated)))
    if sql:
        _SQL[name] = f"{_WITH}{extra} {sql}"


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark, sf_dir):
    return _QUERIES["en02_quality_given_position"](spark, sf_dir)


def _long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _hash(x: str, k: int) -> str:
    return _long(f"list_sum([CAST(strpos('ACGT', substr({x}, j + 1, 1)) - 1 AS BIGINT) * (CAST(1 AS BIGINT) << (2 * ({k} - 1 - j))) for j in range({k})])")


def _codes(x: str) -> str:
    return f"[ascii(substr({x}, j, 1)) for j in range(1, length({x}) + 1)]"


def _kmer_cte(k: int, source: str = "reads", name: str = "km") -> str:
    """(read_idx, pos, raw, kmer): clean k-mers and their canonical form."""
    return f""", {name}_raw AS (SELECT read_idx, CAST(i - 1 AS BIGINT) AS pos, substr(sequence, i, {k}) AS raw FROM {source}, unnest(range(1, length(sequence) - {k} + 2)) t(i)),
  {name} AS (SELECT read_idx, pos, raw, least(raw, {_rc("raw")}) AS kmer FROM {name}_raw WHERE NOT regexp_matches(raw, '[^ACGT]'))"""


def _syncmer_cte(k: int = 21, s: int = 10, offsets=(0,), source: str = "reads", name: str = "sy") -> str:
    tests = " OR ".join(f"(list_position(inner_s, list_min(inner_s)) = {o + 1})" for o in offsets)
    return _kmer_cte(k, source, name + "k") + f""", {name}_in AS (SELECT *, [substr(raw, j, {s}) for j in range(1, {k - s + 2})] AS inner_s FROM {name}k),
  {name} AS (SELECT read_idx, pos, {_hash("kmer", k)} AS hash FROM {name}_in WHERE {tests})"""


# ---- scans, projection, validation ------------------------------------------------------------

_add("io05_chunk_stats", f"""SELECT {_long("read_idx // 1000")} AS chunk_id, count(*) AS reads, {_long("sum(length(sequence))")} AS bases,
  {_long("sum(length(id) + length(sequence) + length(quality) + 3)")} AS bytes FROM reads GROUP BY 1""", lambda r: R.chunk_stats(r, 1000))
_add("io10_fastq_text", "SELECT read_idx, concat(id, chr(10), sequence, chr(10), '+', chr(10), quality) AS value FROM reads", fastq.as_text)
_add("io14_size_statistics", f"""SELECT stream, {_long("bytes")} AS bytes, round(bytes / sum(bytes) OVER (), 6) AS share FROM (
  SELECT 'header' AS stream, sum(length(id)) AS bytes FROM reads UNION ALL SELECT 'sequence', sum(length(sequence)) FROM reads UNION ALL SELECT 'quality', sum(length(quality)) FROM reads)""", archive.size_statistics)
_add("pr01_streams", """SELECT 'header' AS stream, read_idx, encode(id) AS data FROM reads UNION ALL SELECT 'sequence', read_idx, encode(sequence) FROM reads
  UNION ALL SELECT 'quality', read_idx, encode(quality) FROM reads""", R.streams)
_add("pr02_drop_quality", "SELECT read_idx, id, sequence, CAST(NULL AS VARCHAR) AS quality FROM reads", lambda r: r.withColumn("quality", F.lit(None).cast("string")))
_add("pr03_constant_lengths", f"""SELECT {_long("CASE WHEN min(length(sequence)) = max(length(sequence)) THEN min(length(sequence)) ELSE 0 END")} AS const_seq_len,
  {_long("CASE WHEN min(length(quality)) = max(length(quality)) THEN min(length(quality)) ELSE 0 END")} AS const_qual_len FROM reads""", R.constant_lengths)
_add("pr06_reads_with_n", "SELECT read_idx, sequence FROM reads WHERE contains(sequence, 'N')", lambda r: R.split_by_n(r)[1].select("read_idx", "sequence"))
_add("pr06_clean_reads", "SELECT read_idx, sequence FROM reads WHERE NOT contains(sequence, 'N')", lambda r: R.split_by_n(r)[0].select("read_idx", "sequence"))
_add("pr07_first_clean_reads", "SELECT read_idx, id FROM reads WHERE NOT contains(sequence, 'N') ORDER BY read_idx LIMIT 20", lambda r: R.first_reads(r, 20).select("read_idx", "id"))
_add("pr08_read_range", "SELECT read_idx, id, sequence FROM reads WHERE read_idx BETWEEN 99 AND 499", lambda r: R.read_range(r, 100, 500).select("read_idx", "id", "sequence"))
_add("pr09_split_long", f"""SELECT read_idx, {_long("p")} AS part, id, substr(sequence, 1 + 20 * p, 20) AS sequence, substr(quality, 1 + 20 * p, 20) AS quality
  FROM reads, unnest(range(0, (length(sequence) + 19) // 20)) t(p)""", lambda r: R.split_long(r, 20))

# ---- files: write, then read back --------------------------------------------------------------


def _file(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/file-{uuid.uuid4().hex}"


def _one_file(spark, folder: str, name: str) -> str:
    """The only part file of ``folder``, under another name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old = jvm.org.apache.hadoop.fs.Path(folder)
    fs = old.getFileSystem(conf)
    part = [f.getPath() for f in fs.listStatus(old) if f.getPath().getName().startswith("part-")][0]
    new = jvm.org.apache.hadoop.fs.Path(f"{folder}-{name}")
    fs.rename(part, new)
    return new.toString()


def _text_round_trip(fasta: bool = False, name: str | None = None, **options):
    def run(spark, sf_dir):
        path = _file(spark)
        fastq.write_fastq(R.derived_reads(spark, sf_dir), path, fasta, single_file=name is not None, **options)
        return tidy(fastq.read_fastq(spark, _one_file(spark, path, name) if name else path, fasta))

    return run


# record numbers are counted from the file's start
_READ_BACK = "SELECT row_number() OVER (ORDER BY read_idx) - 1 AS read_idx, id, sequence, {quality} AS quality FROM reads"
for _n, _build, _quality in (
    ("io01_fastq_scan", _text_round_trip(name="reads.fastq"), "quality"), ("io02_fasta_scan", _text_round_trip(fasta=True, name="reads.fasta"), "CAST(NULL AS VARCHAR)"),
    ("io03_gzip_scan", _text_round_trip(name="reads.gz", compress=True), "quality"), ("io03_gzip_under_another_name", _text_round_trip(name="reads.fastq", compress=True, level=4), "quality"),
    ("io04_standard_input", None, "quality"),
):
    _add(_n, _READ_BACK.format(quality=_quality), None)
    _QUERIES[_n] = _build


def _from_stdin(spark, sf_dir):
    """Text of a file as standard input."""
    path = _file(spark)
    fastq.write_fastq(R.derived_reads(spark, sf_dir), path, single_file=True)
    local = _one_file(spark, path, "stdin").removeprefix("file:")
    before = sys.stdin
    with open(local) as text:
        sys.stdin = text
        try:
            return tidy(fastq.read_fastq(spark, "-"))
        finally:
            sys.stdin = before


_QUERIES["io04_standard_input"] = _from_stdin


def _parts_back(spark, sf_dir):
    """Ordered part files of a parallel gzip sink, each a whole file of its own."""
    path = _file(spark)
    fastq.write_fastq(R.derived_reads(spark, sf_dir), path, compress=True, level=6)
    return tidy(spark.read.text(path).groupBy((F.length("value") == 64).alias("full")).agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("letters")))


_add("io11_parallel_gzip", f"""SELECT length(v) = 64 AS "full", count(*) AS lines, {_long("sum(length(v))")} AS letters FROM (SELECT id AS v FROM reads UNION ALL SELECT sequence FROM reads UNION ALL SELECT '+' FROM reads UNION ALL SELECT quality FROM reads) GROUP BY 1""", None)
_QUERIES["io11_parallel_gzip"] = _parts_back


def _archived(encoding: str, **options):
    def run(spark, sf_dir):
        path = _file(spark)
        archive.write_archive(R.derived_reads(spark, sf_dir), path, encoding, chunk=options.pop("chunk", 5000), **options)
        return tidy(archive.read_archive(spark, path))

    return run


for _n in archive.ENCODINGS:
    _add(f"io06_archive_{_n}", "SELECT read_idx, id, sequence, quality FROM reads", None)
    _QUERIES[f"io06_archive_{_n}"] = lambda spark, sf, e=_n: _archived(e)(spark, sf)
_add("io06_archive_global_order", "SELECT read_idx, id, sequence, quality FROM reads", None)
_QUERIES["io06_archive_global_order"] = lambda spark, sf: _archived("ordered", order="similarity", chunk=None)(spark, sf)
_add("io08_archive_quality_codecs", "SELECT codec, read_idx, quality FROM reads, (VALUES ('plain'), ('delta'), ('model')) t(codec)", None)
_QUERIES["io08_archive_quality_codecs"] = lambda spark, sf: functools.reduce(
    DataFrame.unionByName, [_archived("raw", quality_codec=c)(spark, sf).select(F.lit(c).alias("codec"), "read_idx", "quality") for c in ("plain", "delta", "model")])
#: fields of a description, each with a value that is not valid
_DAMAGE = {"magic": "XX", "version": 9, "encoding_type": 77, "binning": 99, "quality_codec": 42, "num_reads": -1, "chunk": 0}


def _damaged(spark, sf_dir):
    """Which damaged descriptions are refused."""
    path = _file(spark)
    archive.write_archive(R.derived_reads(spark, sf_dir), path, "raw")
    meta, out = archive.read_meta(spark, path), [("whole", False)]
    for field, value in _DAMAGE.items():
        bad = f"{path}-{field}"
        spark.createDataFrame([tuple((meta | {field: value}).values())], archive.META).coalesce(1).write.json(f"{bad}/meta")
        try:
            archive.read_meta(spark, bad)
            out.append((field, False))
        except ValueError:
            out.append((field, True))
    return spark.createDataFrame(out, "field string, refused boolean")


_SQL["io09_damaged_headers"] = "SELECT * FROM (VALUES ('whole', false), " + ", ".join(f"('{f}', true)" for f in _DAMAGE) + ") t(field, refused)"
_QUERIES["io09_damaged_headers"] = _damaged


def _refusals(cases):
    """(name, refused) of calls that must or must not raise ValueError."""
    out = []
    for name, call in cases:
        try:
            call()
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return out


_SQL["io15_several_inputs"] = "SELECT * FROM (VALUES ('none', true), ('two', true)) t(files, refused)"
_QUERIES["io15_several_inputs"] = lambda spark, sf: spark.createDataFrame(_refusals([("none", lambda: fastq.read_fastq(spark, [])), ("two", lambda: fastq.read_fastq(spark, ["a", "b"]))]), "files string, refused boolean")
_WAYS = {"reorder": "local", "local_reorder": True, "ultra": 3, "inline_delta": True, "hints": True, "canonical": True}
_SQL["pr04_option_pairs"] = f"WITH w AS (SELECT unnest({list(_WAYS)}) AS name) SELECT a.name AS a, b.name AS b, a.name <> b.name AS refused FROM w a, w b"
_QUERIES["pr04_option_pairs"] = lambda spark, sf: spark.createDataFrame([(a, b, bad) for a in _WAYS for b in _WAYS for _, bad in _refusals([(a, api.Options(**{a: _WAYS[a], b: _WAYS[b]}).check)])], "a string, b string, refused boolean")


def _streamable(spark, sf_dir):
    """Archives by encoding and quality codec, and whether their reads come back one by one."""
    first = R.first_reads(R.derived_reads(spark, sf_dir), 50)
    out = []
    for e in archive.ENCODINGS:
        for c in ("plain", "delta", "model"):
            path = _file(spark)
            archive.write_archive(first, path, e, quality_codec=c)
            out.append((e, c, api.can_stream(archive.read_meta(spark, path))))
    return spark.createDataFrame(out, "encoding string, codec string, streams boolean")


_SQL["pr05_streaming_eligibility"] = f"SELECT e AS encoding, c AS codec, c = 'plain' AND e IN ('raw', 'hints', 'canonical') AS streams FROM (SELECT unnest({list(archive.ENCODINGS)}) AS e), (SELECT unnest(['plain', 'delta', 'model']) AS c)"
_QUERIES["pr05_streaming_eligibility"] = _streamable

# ---- sequence functions -------------------------------------------------------------------------

_add("sq01_reverse_complement", f"SELECT read_idx, {_rc('sequence')} AS rc FROM reads", lambda r: r.select("read_idx", S.reverse_complement("sequence").alias("rc")))
_add("sq02_reverse_complement_keep", f"SELECT read_idx, {_rc('translate(sequence, chr(78), chr(45))')} AS rc FROM reads", lambda r: r.select("read_idx", S.reverse_complement(F.translate("sequence", "N", "-"), keep_unknown=True).alias("rc")))
_add("sq03_canonical", f"SELECT read_idx, least(sequence, {_rc('sequence')}) AS sequence, {_rc('sequence')} < sequence AS was_reversed FROM reads", lambda r: r.select("read_idx", S.canonical("sequence").alias("c")).select("read_idx", "c.*"))
_add("sq04_restore_strand", "SELECT read_idx, sequence AS restored FROM reads", lambda r: r.select("read_idx", S.canonical("sequence").alias("c")).select("read_idx", S.restore_strand("c.sequence", F.col("c.was_reversed")).alias("restored")))
_add("sq05_kmer_hash", f"SELECT read_idx, pos, CASE WHEN NOT regexp_matches(raw, '[^ACGT]') THEN {_hash('raw', 15)} END AS hash FROM km_raw", lambda r: r.select("read_idx", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("sequence") - 14), lambda i: F.substring("sequence", i, F.lit(15)))).alias("pos", "raw")).select("read_idx", "pos", S.kmer_hash("raw").alias("hash")), extra=_kmer_cte(15))
_add("sq06_rc_hash", f"SELECT read_idx, pos, {_hash(_rc('raw'), 15)} AS hash FROM km", lambda r: kmers.explode_kmers(r, 15).select("read_idx", "pos", S.reverse_complement_hash(S.kmer_hash("kmer"), 15).alias("hash")), extra=_kmer_cte(15))
_add("sq07_hash_to_kmer", "SELECT read_idx, pos, raw AS kmer FROM km", lambda r: kmers.explode_kmers(r, 21).select("read_idx", "pos", S.hash_kmer(S.kmer_hash("kmer"), 21).alias("kmer")), extra=_kmer_cte(21))
_add("sq08_canonical_kmers", f"SELECT read_idx, pos, {_hash('kmer', 21)} AS hash, raw = kmer AS is_forward FROM km", lambda r: r.select("read_idx", F.explode(S.canonical_kmers("sequence", 21)).alias("x")).select("read_idx", "x.pos", "x.hash", "x.is_forward"), extra=_kmer_cte(21))
_add("sq09_hamming_within", """SELECT read_idx, CASE WHEN d <= 1 THEN d END AS distance FROM (SELECT m.read_idx, CAST(len([1 for j in range(1, 65) if substr(m.sequence, j, 1) <> substr(r.sequence, j, 1)]) AS BIGINT) AS d
  FROM mutated m JOIN reads r USING (read_idx))""", None)
_QUERIES["sq09_hamming_within"] = lambda spark, sf: tidy(R.derived_reads(spark, sf, True).alias("m").join(R.derived_reads(spark, sf).alias("r"), "read_idx").select("read_idx", S.hamming_within(F.col("m.sequence"), F.col("r.sequence"), 1).alias("distance")))
_add("sq10_shannon_entropy", """SELECT read_idx, round(list_sum([CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END for p in ps]), 6) AS h
  FROM (SELECT read_idx, [(length(sequence) - length(replace(sequence, b, ''))) / length(sequence) for b in ['A', 'C', 'G', 'T']] AS ps FROM reads)""", lambda r: r.select("read_idx", S.shannon_entropy("sequence").alias("h")))
_add("sq11_pack_round_trip", "SELECT read_idx, sequence AS unpacked, CAST(2 + CASE WHEN contains(sequence, 'N') THEN 32 ELSE 16 END AS BIGINT) AS bytes FROM reads",
     lambda r: r.select("read_idx", S.pack_bases("sequence").alias("p")).select("read_idx", S.unpack_bases("p").alias("unpacked"), F.octet_length("p").alias("bytes")))
_add("sq12_n_mask", "SELECT read_idx, replace(sequence, 'N', 'A') AS bases, sequence AS back FROM reads", lambda r: r.select("read_idx", S.mask_n("sequence").alias("m")).select("read_idx", "m.bases", S.unmask_n("m.bases", "m.positions").alias("back")))
_add("sq13_n_statistics", f"""SELECT read_idx, {_long("len(n)")} AS n_count, array_to_string(n, ',') AS positions, round(100.0 * len(n) / length(sequence), 6) AS percent
  FROM (SELECT read_idx, sequence, [j - 1 for j in range(1, length(sequence) + 1) if substr(sequence, j, 1) = 'N'] AS n FROM reads)""",
     lambda r: r.select("read_idx", "sequence", S.n_positions("sequence").alias("n")).select("read_idx", F.size("n").alias("n_count"), F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("positions"), (100.0 * F.size("n") / F.length("sequence")).alias("percent")))
_add("sq14_center_windows", "SELECT read_idx, translate(substr(sequence, 13, 20), 'N', 'A') AS \"left\", translate(substr(sequence, 33, 20), 'N', 'A') AS \"right\" FROM reads", lambda r: r.select("read_idx", S.center_windows("sequence").alias("w")).select("read_idx", "w.*"))
_add("sq15_min_syncmer", "SELECT read_idx, min(hash) AS hash, arg_min(pos, struct_pack(h := hash, p := pos)) AS pos FROM sy GROUP BY read_idx",
     lambda r: r.select("read_idx", F.explode(F.array_compact(F.array(S.min_syncmer("sequence")))).alias("s")).select("read_idx", "s.hash", "s.pos"), extra=_syncmer_cte())
_add("sq16_closed_syncmers", "SELECT read_idx, pos, hash FROM sy", lambda r: r.select("read_idx", F.explode(S.syncmers("sequence", 21, 10, (0, 11))).alias("x")).select("read_idx", "x.pos", "x.hash"), extra=_syncmer_cte(offsets=(0, 11)))
_add("sq17_hint_byte", "SELECT read_idx, coalesce(min(hash) >> 34, 255) AS hint FROM reads LEFT JOIN sy USING (read_idx) GROUP BY read_idx", lambda r: r.select("read_idx", S.hint_byte("sequence").alias("hint")), extra=_syncmer_cte())
_add("sq18_minimizers", f"""SELECT read_idx, CAST(count(*) AS BIGINT) AS n, min(h) AS lowest FROM (SELECT read_idx, i, h, lag(h) OVER (PARTITION BY read_idx ORDER BY i) AS before FROM (
    SELECT read_idx, i, min(hash) OVER (PARTITION BY read_idx ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS h, count(*) OVER (PARTITION BY read_idx ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS room
    FROM (SELECT read_idx, row_number() OVER (PARTITION BY read_idx ORDER BY pos) AS i, {_hash('kmer', 15)} AS hash FROM km)) WHERE room = 11) WHERE before IS NULL OR h <> before GROUP BY read_idx""",
     lambda r: r.select("read_idx", S.minimizers("sequence", 15, 11).alias("m")).filter(F.size("m") > 0).select("read_idx", F.size("m").cast("long").alias("n"), F.array_min("m").alias("lowest")), extra=_kmer_cte(15))
_add("sq19_min_kmer", f"SELECT read_idx, min({_hash('kmer', 21)}) AS hash FROM reads LEFT JOIN km USING (read_idx) GROUP BY read_idx", lambda r: r.select("read_idx", S.min_kmer("sequence").alias("hash")), extra=_kmer_cte(21))
_add("sq20_bottom_sketch", f"SELECT read_idx, array_to_string(list_sort(list(DISTINCT {_hash('kmer', 21)}))[1:4], ',') AS sketch FROM km GROUP BY read_idx",
     lambda r: r.select("read_idx", S.bottom_sketch(F.transform(S.canonical_kmers("sequence", 21), lambda x: x["hash"]), 4).alias("s")).filter(F.get("s", F.lit(0)).isNotNull()).select("read_idx", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sketch")), extra=_kmer_cte(21))
_add("sq21_sort_keys", f"""SELECT read_idx, {_long("list_sum(c) // len(c)")} AS mean, {_long("list_sum([x * x for x in c])")} AS norm2, {_long("list_min(c)")} AS low,
  {_long("list_sum([(x - list_sum(c) // len(c)) * (x - list_sum(c) // len(c)) for x in c]) // len(c)")} AS variance FROM (SELECT read_idx, {_codes('quality')} AS c FROM reads)""",
     lambda r: r.select("read_idx", S.mean_byte("quality").alias("mean"), S.norm2("quality").alias("norm2"), F.array_min(S.byte_values("quality")).alias("low"), S.byte_variance("quality").alias("variance")))
_add("sq22_profile", f"SELECT read_idx, array_to_string([list_sum(c[8 * b + 1 : 8 * b + 8]) // 8 for b in range(8)], ',') AS profile FROM (SELECT read_idx, {_codes('quality')} AS c FROM reads)",
     lambda r: r.select("read_idx", F.array_join(F.transform(S.profile("quality", 8), lambda x: x.cast("string")), ",").alias("profile")))
_add("sq23_ends_key", "SELECT read_idx, concat(substr(sequence, 1, 16), right(sequence, 16)) AS k FROM reads", lambda r: r.select("read_idx", S.ends_key("sequence").alias("k")))
_add("sq24_best_shift", f"""SELECT read_idx, shift, votes FROM (SELECT k.read_idx, r.p - k.pos AS shift, count(*) AS votes, row_number() OVER (PARTITION BY k.read_idx ORDER BY count(*) DESC, r.p - k.pos) AS n
  FROM km_raw k JOIN (SELECT raw, min(pos) AS p FROM km_raw WHERE read_idx = 0 AND NOT contains(raw, 'N') GROUP BY raw) r ON k.raw = r.raw GROUP BY k.read_idx, r.p - k.pos) WHERE n = 1""",
     lambda r: consensus.best_shift(r, 0, 5), extra=_kmer_cte(5, "mutated"), mutated=True)
_add("sq25_varint_size", f"SELECT read_idx, {_long('CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END')} AS size FROM (SELECT read_idx, read_idx * 1000 AS v FROM reads)", lambda r: r.select("read_idx", S.varint_size(F.col("read_idx") * 1000).alias("size")))
_add("sq26_zigzag", "SELECT read_idx, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z, d AS back FROM (SELECT read_idx, 500 - read_idx AS d FROM reads)", lambda r: r.select("read_idx", S.zigzag(500 - F.col("read_idx")).alias("z")).select("read_idx", "z", S.unzigzag("z").alias("back")))

# ---- quality functions ----------------------------------------------------------------------------


def _ladder(x: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {low} THEN {v}" for low, v in reversed(table)) + " END"


_add("ql01_phred", f"SELECT read_idx, {_long('list_sum([x - 33 for x in c])')} AS total, {_long('list_max(c) - 33')} AS top FROM (SELECT read_idx, {_codes('quality')} AS c FROM reads)",
     lambda r: r.select("read_idx", F.aggregate(Q.phred("quality"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(Q.phred("quality")).alias("top")))
for _n, _mode in (("ql02_illumina_bin", "illumina_bin"), ("ql02_illumina_bin_std", "illumina_bin_std"), ("ql03_four_level", "four_level"), ("ql04_binary", "binary"), ("ql05_discard", "discard")):
    _add(_n, f"SELECT read_idx, array_to_string([chr(CAST(33 + {_ladder('x - 33', Q.MODES[_mode])} AS INT)) for x in {_codes('quality')}], '') AS quality FROM reads", lambda r, m=_mode: r.select("read_idx", Q.quantize("quality", m).alias("quality")))
_add("ql02_by_decade", f"SELECT read_idx, array_to_string([chr(CAST(33 + {_ladder('x - 33', Q.QUANTIZED)} AS INT)) for x in {_codes('quality')}], '') AS quality FROM reads", lambda r: r.select("read_idx", Q.quantize_by_decade("quality").alias("quality")))
for _k, (_cuts, _values, _) in Q.CODES.items():
    if _cuts:
        _code = " + ".join(f"CASE WHEN x - 33 >= {c} THEN 1 ELSE 0 END" for c in _cuts)
        _add(f"ql06_codes_{_k}", f"SELECT read_idx, array_to_string([{_code} for x in {_codes('quality')}], '') AS codes FROM reads", lambda r, k=_k: r.select("read_idx", F.array_join(F.transform(Q.bin_codes("quality", k), lambda x: x.cast("string")), "").alias("codes")))
        _add(f"ql07_values_{_k}", f"SELECT read_idx, array_to_string([chr(CAST(33 + {list(_values)}[1 + {_code}] AS INT)) for x in {_codes('quality')}], '') AS quality FROM reads", lambda r, k=_k: r.select("read_idx", Q.bin_values(Q.bin_codes("quality", k), k).alias("quality")))
_add("ql08_packed_codes", f"SELECT read_idx, {_long('24')} AS bytes, array_to_string([{' + '.join(f'CASE WHEN x - 33 >= {c} THEN 1 ELSE 0 END' for c in Q.CODES['illumina8'][0])} for x in {_codes('quality')}], '') AS codes FROM reads",
     lambda r: r.select("read_idx", F.length("quality").alias("n"), Q.pack_codes("illumina8")(Q.bin_codes("quality", "illumina8")).alias("p")).select("read_idx", F.octet_length("p").alias("bytes"), F.array_join(F.transform(Q.unpack_codes("illumina8")("p", "n"), lambda x: x.cast("string")), "").alias("codes")))
_add("ql09_mean_quality", f"SELECT read_idx, {_long('list_sum(c) // len(c)')} AS mean FROM (SELECT read_idx, {_codes('quality')} AS c FROM reads)", lambda r: r.select("read_idx", Q.mean_quality("quality").alias("mean")))
_QD = _BASES + ", qd AS (SELECT read_idx, pos, phred - coalesce(lag(phred) OVER (PARTITION BY pos, read_idx // 1000 ORDER BY read_idx), 0) AS d FROM bases)"
_add("ql10_quality_delta", f"SELECT read_idx, array_to_string(list(d ORDER BY pos), ',') AS deltas FROM qd GROUP BY read_idx", lambda r: delta.quality_delta(r, 1000).select("read_idx", F.array_join(F.transform("deltas", lambda x: x.cast("string")), ",").alias("deltas")), extra=_QD)
_add("ql11_quality_undelta", "SELECT read_idx, quality FROM reads", lambda r: delta.undo_quality_delta(delta.quality_delta(r, 1000)))
_add("ql12_delta_statistics", f"SELECT count(*) AS n, {_long('sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)')} AS zeros, {_long('sum(CASE WHEN abs(d) BETWEEN 1 AND 3 THEN 1 ELSE 0 END)')} AS small, {_long('max(abs(d))')} AS largest FROM qd WHERE read_idx % 1000 <> 0", lambda r: delta.quality_delta_stats(r, 1000), extra=_QD)
_MODEL = _BASES + ", model AS (SELECT pos, list_sort(list(phred))[len(list(phred)) // 2 + 1] AS median FROM bases GROUP BY pos)"
_add("ql13_positional_model", f"SELECT pos, median FROM model", delta.quality_model, extra=_MODEL)
_add("ql14_model_residual", "SELECT read_idx, pos, phred - median AS residual FROM bases JOIN model USING (pos)", lambda r: delta.model_residual(r, delta.quality_model(r)), extra=_MODEL)
_add("ql14_model_restore", "SELECT read_idx, quality FROM reads", lambda r: (lambda m: delta.undo_model_residual(delta.model_residual(r, m), m))(delta.quality_model(r)))


def _contexts(r):
    return R.bases(r, context=True)


def _context_id(rows):
    """Context of a score: position bin, previous score, steadiness, previous and present base."""
    moving = (F.abs(F.col("q1") - F.col("q2")) > 2).cast("int")
    base = lambda c: F.instr(F.lit("ACGTN"), F.col(c)) - 1
    return rows.withColumn("ctx", (((Q.position_bin("pos") * 50 + F.least("q1", F.lit(49))) * 2 + moving) * 25 + base("b1") * 5 + base("base")).cast("long"))


_CTX_SQL = "CAST(((least(pos // 5, 63) * 50 + least(q1, 49)) * 2 + CASE WHEN abs(q1 - q2) > 2 THEN 1 ELSE 0 END) * 25 + (strpos('ACGTN', b1) - 1) * 5 + strpos('ACGTN', base) - 1 AS BIGINT)"
_add("ql16_context_counts", f"SELECT {_CTX_SQL} AS ctx, phred, count(*) AS n FROM context GROUP BY 1, 2", lambda r: _context_id(_contexts(r)).groupBy("ctx", "phred").agg(F.count("*").alias("n")), extra=_CONTEXT)
_ADAPT = "-log2((1 + count(*) OVER (PARTITION BY {c}, {s} ORDER BY read_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / ({n} + count(*) OVER (PARTITION BY {c} ORDER BY read_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"


def _cost_sql(c: str, s: str, n: int, source: str = "context") -> str:
    return f"SELECT count(*) AS n, round(sum(bits) / 1000, 3) AS kbits FROM (SELECT {_ADAPT.format(c=c, s=s, n=n)} AS bits FROM {source})"


def _kbits(df):
    return df.select("n", F.round(F.col("bits") / 1000, 3).alias("kbits"))


#: fixed values: totals at which the models halve their counts
CONTEXT_LIMIT, RELATIVE_LIMIT, COLUMN_LIMIT = 1 << 20, 1 << 15, 1 << 15
BLOCK = 100_000


def _halving_sql(keys: str, code: str, symbols: int, limit: int, block: int, prior: int, half: str, source: str) -> str:
    """The model step by step: a list of bits and counts is folded over each context's symbols."""
    counts = f"[a[i] + CASE WHEN i = x[1] + 2 THEN 1 ELSE 0 END for i in range(2, {symbols + 2})]"
    return f"""SELECT {_long("sum(len(s))")} AS n, round(sum(list_reduce([[CAST(v AS DOUBLE)] for v in s], lambda a, x: list_concat([a[1] - log2(a[CAST(x[1] AS INT) + 2] / list_sum(a[2:]))],
      CASE WHEN list_sum(a[2:]) + 1 >= {limit} THEN [{half} for c in {counts}] ELSE {counts} END), list_concat([CAST(0 AS DOUBLE)], [CAST({prior} AS DOUBLE) for i in range({symbols})]))[1]) / 1000, 3) AS kbits
      FROM (SELECT list({code} ORDER BY read_idx, pos) AS s FROM {source} GROUP BY read_idx // {block}, {keys})"""


_DOWN, _UP = "greatest(floor(c / 2), 1)", "floor((c + 1) / 2)"
_add("ql17_context_cost", _cost_sql(f"read_idx // {BLOCK}, ctx", "phred", 41, f"(SELECT *, {_CTX_SQL} AS ctx FROM context)"), lambda r: _kbits(entropy.halving_cost(_context_id(_contexts(r)), ["ctx"], "phred", 41, CONTEXT_LIMIT, BLOCK)), extra=_CONTEXT)
_add("ql17_halved_context_cost", _halving_sql("q1", "phred", 41, 400, 500, 1, _DOWN, "context"), lambda r: _kbits(entropy.halving_cost(R.bases(r, context=["q1"]), ["q1"], "phred", 41, 400, 500)), extra=_CONTEXT)
_add("ql18_alphabet", "SELECT phred, count(*) AS n, row_number() OVER (ORDER BY phred) - 1 AS code FROM bases GROUP BY phred", lambda r: R.bases(r).groupBy("phred").agg(F.count("*").alias("n")).withColumn("code", F.row_number().over(Window.orderBy("phred")) - 1), extra=_BASES)
_add("ql20_mean_sorted", f"SELECT read_idx // 5000 AS chunk_id, (read_idx // 5000) * 5000 + row_number() OVER (PARTITION BY read_idx // 5000 ORDER BY list_sum(c) // len(c), read_idx) - 1 AS new_pos, read_idx FROM (SELECT read_idx, {_codes('quality')} AS c FROM reads)", lambda r: reorder.mean_sorted(r, 5000))
def _relative(r):
    return R.bases(r, context=["q1"]).withColumn("p", Q.relative_bin("pos", F.lit(64))).withColumn("q", F.least("q1", F.lit(40)))


_add("ql22_simple_context", "SELECT CASE WHEN pos < 8 THEN pos ELSE 8 + pos // 8 END AS p, least(q1, 15) AS q, phred, count(*) AS n FROM context GROUP BY 1, 2, 3", lambda r: _contexts(r).groupBy(Q.simple_position_bin("pos").alias("p"), F.least("q1", F.lit(15)).alias("q"), "phred").agg(F.count("*").alias("n")), extra=_CONTEXT)
_add("ql23_relative_context_cost", _cost_sql(f"read_idx // {BLOCK}, p, q, base", "phred", 41, "(SELECT *, least(pos * 20 // 64, 19) AS p, least(q1, 40) AS q FROM context)"), lambda r: _kbits(entropy.halving_cost(_relative(r), ["p", "q", "base"], "phred", 41, RELATIVE_LIMIT, BLOCK, round_up=True)), extra=_CONTEXT)
_add("ql23_halved_relative_cost", _halving_sql("p, q, base", "phred", 41, 60, 5000, 1, _UP, "(SELECT *, least(pos * 20 // 64, 19) AS p, least(q1, 40) AS q FROM context)"), lambda r: _kbits(entropy.halving_cost(_relative(r), ["p", "q", "base"], "phred", 41, 60, 5000, round_up=True)), extra=_CONTEXT)
_add("ql24_sequence_markov_cost", f"SELECT count(*) AS n, round(sum(bits) / 1000, 3) AS kbits FROM (SELECT -log2((10 + 4 * count(*) OVER (PARTITION BY b1, b2, p, base ORDER BY read_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / (50 + 4 * count(*) OVER (PARTITION BY b1, b2, p ORDER BY read_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS bits FROM (SELECT *, pos * 10 // 64 AS p FROM context))",
     lambda r: _kbits(entropy.adaptive_cost(_contexts(r).withColumn("p", F.floor(F.col("pos") * 10 / 64)), ["b1", "b2", "p"], "base", 5, prior=10, step=4)), extra=_CONTEXT)
_add("ql26_run_lengths", "SELECT read_idx, CAST(len(regexp_extract_all(quality, 'I*[^I]')) + CASE WHEN quality LIKE '%I' THEN 1 ELSE 0 END AS BIGINT) AS runs, CAST(length(quality) - length(replace(quality, 'I', '')) AS BIGINT) AS letters FROM reads",
     lambda r: r.select("read_idx", Q.run_lengths("quality", "I").alias("x")).select("read_idx", F.size("x").alias("runs"), F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["run"]).alias("letters")))

# ---- headers --------------------------------------------------------------------------------------

_PARTS = ", parts AS (SELECT read_idx, id, string_split(split_part(substr(id, 2), ' ', 1), ':') AS f, split_part(id, ' ', 2) AS comment FROM reads)"
_add("hd01_dialect", "SELECT 'casava' AS dialect, count(*) AS n FROM reads", lambda r: r.groupBy(H.dialect("id").alias("dialect")).agg(F.count("*").alias("n")))
_add("hd03_casava_fields", "SELECT read_idx, concat(f[1], ':', f[2], ':', f[3]) AS combo, '' AS umi, comment, CAST(f[4] AS BIGINT) AS lane, CAST(f[5] AS BIGINT) AS tile, CAST(f[6] AS BIGINT) AS x, CAST(f[7] AS BIGINT) AS y FROM parts", lambda r: r.select("read_idx", H.parse_casava("id").alias("p")).select("read_idx", "p.*"), extra=_PARTS)
_add("hd02_sra_fields", "SELECT read_idx, 'SIM' AS prefix, concat(f[1], ':', f[2], ':', f[3]) AS combo, '/1' AS pair, read_idx + 1 AS read_num, CAST(f[4] AS BIGINT) AS lane, CAST(f[5] AS BIGINT) AS tile, CAST(f[6] AS BIGINT) AS x, CAST(f[7] AS BIGINT) AS y FROM parts",
     lambda r: r.select("read_idx", H.parse_sra(F.concat(F.lit("@SIM."), (F.col("read_idx") + 1).cast("string"), F.lit(" "), F.substring_index(F.expr("substring(id, 2)"), " ", 1), F.lit("/1"))).alias("p")).select("read_idx", "p.*"), extra=_PARTS)
_add("hd04_all_or_nothing", "SELECT true AS whole, count(*) AS n FROM reads", lambda r: r.agg(F.bool_and(H.parse_casava("id").isNotNull() & H.lossless("id")).alias("whole"), F.count("*").alias("n")))
_add("hd05_combo_dictionary", "SELECT combo, row_number() OVER (ORDER BY first) - 1 AS combo_idx FROM (SELECT concat(f[4], ':', f[5]) AS combo, min(read_idx) AS first FROM parts GROUP BY 1)",
     lambda r: (lambda d: d.select("combo", (F.row_number().over(Window.orderBy("first")) - 1).alias("combo_idx")))(r.select("read_idx", H.parse_casava("id").alias("p")).groupBy(F.concat_ws(":", F.col("p.lane").cast("string"), F.col("p.tile").cast("string")).alias("combo")).agg(F.min("read_idx").alias("first"))), extra=_PARTS)
_add("hd06_common_comment", "SELECT CASE WHEN count(DISTINCT comment) = 1 THEN min(comment) END AS comment FROM parts", lambda r: r.select(H.parse_casava("id")["comment"].alias("c")).agg(F.when(F.min("c") == F.max("c"), F.min("c")).alias("comment")), extra=_PARTS)
_add("hd07_rebuild", "SELECT read_idx, id AS rebuilt, true AS lossless FROM reads", lambda r: r.select("read_idx", H.build_casava(H.parse_casava("id")).alias("rebuilt"), H.lossless("id").alias("lossless")))
_add("hd08_template", "SELECT read_idx, concat_ws(':', concat('@', f[1]), f[2], f[3], f[4], f[5]) AS prefix, CAST(f[6] AS BIGINT) AS x, CAST(f[7] AS BIGINT) AS y, comment FROM parts", lambda r: r.select("read_idx", H.template("id").alias("t")).select("read_idx", "t.*"), extra=_PARTS)
_HDELTA = _PARTS + ", hd AS (SELECT read_idx, read_idx // 1000 AS chunk_id, CAST(f[6] AS BIGINT) - lag(CAST(f[6] AS BIGINT), 1, 0) OVER w AS dx, CAST(f[7] AS BIGINT) - lag(CAST(f[7] AS BIGINT), 1, 0) OVER w AS dy FROM parts WINDOW w AS (PARTITION BY read_idx // 1000 ORDER BY read_idx))"


def _xy(r):
    return r.select("read_idx", H.template("id").alias("t")).select("read_idx", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))


_add("hd09_coordinate_delta", "SELECT chunk_id, read_idx, dx, dy FROM hd", lambda r: delta.header_deltas(_xy(r), 1000), extra=_HDELTA)
_add("hd10_coordinate_undelta", "SELECT read_idx, CAST(f[6] AS BIGINT) AS x, CAST(f[7] AS BIGINT) AS y FROM parts", lambda r: delta.header_undelta(delta.header_deltas(_xy(r), 1000)), extra=_PARTS)
_add("hd11_pair_pattern", "SELECT CAST(CASE WHEN read_idx % 3 = 0 THEN 1 WHEN read_idx % 3 = 1 THEN 2 ELSE 3 END AS BIGINT) AS pattern, count(*) AS n FROM reads GROUP BY 1",
     lambda r: r.select(F.when(F.col("read_idx") % 3 == 0, F.concat(F.substring_index("id", " ", 1), F.lit("/1"))).otherwise(F.col("id")).alias("a"), F.when(F.col("read_idx") % 3 == 0, F.concat(F.substring_index("id", " ", 1), F.lit("/2"))).when(F.col("read_idx") % 3 == 1, F.col("id")).otherwise(F.replace("id", F.lit(" 1:"), F.lit(" 2:"))).alias("b")).groupBy(H.pair_pattern("a", "b").alias("pattern")).agg(F.count("*").alias("n")))
_add("hd12_tokens", "SELECT read_idx, array_to_string(regexp_extract_all(id, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]'), '|') AS tokens FROM reads", lambda r: r.select("read_idx", F.array_join(H.tokens("id"), "|").alias("tokens")))

# ---- grouping, ordering, joining, clustering --------------------------------------------------------

_ORDER = "SELECT read_idx // 5000 AS chunk_id, (read_idx // 5000) * 5000 + row_number() OVER (PARTITION BY read_idx // 5000 ORDER BY {keys}, read_idx) - 1 AS new_pos, read_idx FROM {source}"
_add("gr01_similarity_order", _ORDER.format(keys="hash NULLS LAST, pos NULLS LAST, mean", source=f"(SELECT r.read_idx, s.hash, s.pos, list_sum({_codes('quality')}) // 64 AS mean FROM reads r LEFT JOIN (SELECT read_idx, min(hash) AS hash, arg_min(pos, struct_pack(h := hash, p := pos)) AS pos FROM sy GROUP BY read_idx) s USING (read_idx))"), lambda r: reorder.similarity(r, 5000), extra=_syncmer_cte())
_add("gr02_global_order", "SELECT read_idx, id FROM reads", lambda r: reorder.similarity_global(r).select("read_idx", "id"))
_GROUPED = ", grouped AS (SELECT read_idx, min(read_idx) OVER (PARTITION BY read_idx // 5000, translate(substr(sequence, 13, 20), 'N', 'A')) AS g FROM reads)"
_add("gr03_center_order", _ORDER.format(keys="g", source="grouped"), lambda r: reorder.center(r, 5000), extra=_GROUPED)
_add("gr04_identity_order", "SELECT read_idx // 5000 AS chunk_id, read_idx AS new_pos, read_idx FROM reads", lambda r: reorder.identity(r, 5000))
_LISTS = f""", hashed AS (SELECT read_idx, row_number() OVER (PARTITION BY read_idx ORDER BY pos) AS i, {_hash('kmer', 15)} AS hash FROM km),
  posts AS (SELECT DISTINCT h AS hash, read_idx FROM (SELECT read_idx, min(hash) OVER w AS h, count(*) OVER w AS room FROM hashed WINDOW w AS (PARTITION BY read_idx ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)) WHERE room = 11),
  usable AS (SELECT * FROM posts WHERE hash IN (SELECT hash FROM posts GROUP BY hash HAVING count(*) BETWEEN 2 AND 50)),
  edges AS (SELECT a.read_idx AS a, b.read_idx AS b, count(*) AS shared FROM usable a JOIN usable b ON a.hash = b.hash AND a.read_idx < b.read_idx GROUP BY 1, 2 HAVING count(*) >= 2)"""
_EDGES = _kmer_cte(15, "mutated") + _LISTS
_add("gr05_minimizer_postings", "SELECT hash, read_idx FROM posts", lambda r: kmers.minimizer_postings(r, 15, 11), mutated=True, extra=_EDGES)
_add("gr06_usable_postings", "SELECT hash, read_idx FROM usable", lambda r: clusters.usable_postings(r, 15, 11), mutated=True, extra=_EDGES)
_add("gr07_shared_edges", "SELECT a, b, shared FROM edges", lambda r: clusters.shared_edges(clusters.usable_postings(r, 15, 11)), mutated=True, extra=_EDGES)
_COMPONENTS = _EDGES + """, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), walk AS (SELECT read_idx AS a, read_idx AS b FROM mutated UNION SELECT w.a, e.b FROM walk w JOIN both_ways e ON w.b = e.a),
  labels AS (SELECT a AS read_idx, min(b) AS label FROM walk GROUP BY a)"""
_add("gr08_components", "SELECT read_idx, label FROM labels", lambda r: clusters.clusters(r, "selective", 15, 11), mutated=True, extra=_COMPONENTS)
_SQL["gr08_components"] = _SQL["gr08_components"].replace("WITH reads", "WITH RECURSIVE reads", 1)
_add("gr08_star_components", "SELECT read_idx, label FROM labels", lambda r: clusters.clusters(r, "all", 15, 11), mutated=True,
     extra=_EDGES + _COMPONENTS[len(_EDGES) :].replace("FROM edges", "FROM stars").replace(", both_ways", ", stars AS (SELECT DISTINCT low AS a, read_idx AS b FROM posts JOIN (SELECT hash, min(read_idx) AS low FROM posts GROUP BY hash) USING (hash) WHERE low < read_idx), both_ways", 1))
_SQL["gr08_star_components"] = _SQL["gr08_star_components"].replace("WITH reads", "WITH RECURSIVE reads", 1)
_add("gr09_component_order", _ORDER.format(keys="label", source="labels"), lambda r: reorder.by_component(r, clusters.clusters(r, "selective", 15, 11), 5000), mutated=True, extra=_COMPONENTS)
_SQL["gr09_component_order"] = _SQL["gr09_component_order"].replace("WITH reads", "WITH RECURSIVE reads", 1)
_add("gr10_inverse_order", f"SELECT chunk_id, read_idx AS new_pos, new_pos AS read_idx FROM ({_ORDER.format(keys='g', source='grouped')})", lambda r: reorder.inverse(reorder.center(r, 5000)), extra=_GROUPED)
_CHANGE = "array_to_string([CASE WHEN substr(sequence, j, 1) = substr(before, j, 1) THEN '0' ELSE translate(substr(sequence, j, 1), 'ACGTN', '12345') END for j in range(1, length(sequence) + 1)], '')"
_add("gr11_inline_delta", f"""SELECT read_idx, CASE WHEN near THEN before_idx END AS base_idx, CASE WHEN near THEN {_CHANGE} ELSE sequence END AS delta FROM (
  SELECT *, before IS NOT NULL AND h IS NOT NULL AND len([1 for j in range(1, 65) if substr(sequence, j, 1) = substr(before, j, 1)]) > 0.6 * 64 AS near FROM (
    SELECT read_idx, sequence, h, lag(sequence) OVER w AS before, lag(read_idx) OVER w AS before_idx FROM (SELECT m.read_idx, m.sequence, s.h FROM mutated m LEFT JOIN (SELECT read_idx, min(hash) AS h FROM sy GROUP BY read_idx) s USING (read_idx))
    WINDOW w AS (PARTITION BY read_idx // 5000, h ORDER BY read_idx)))""", lambda r: delta.inline_delta(r, 5000), mutated=True, extra=_syncmer_cte(source="mutated"))
_add("gr11_inline_undelta", "SELECT read_idx, sequence FROM mutated", lambda r: delta.undo_inline_delta(delta.inline_delta(r, 5000), 5000), mutated=True)
_add("gr12_previous_read_delta", f"SELECT read_idx // 5000 AS chunk_id, read_idx, {_CHANGE} AS delta FROM (SELECT read_idx, sequence, coalesce(lag(sequence) OVER (PARTITION BY read_idx // 5000 ORDER BY read_idx), '') AS before FROM mutated)", lambda r: delta.previous_read_delta(r, chunk=5000), mutated=True)
_add("gr12_previous_read_undelta", "SELECT read_idx, sequence FROM mutated", lambda r: delta.undo_previous_read_delta(delta.previous_read_delta(r, chunk=5000)), mutated=True)
for _n, _strategy, _column, _keys in (
    ("lexicographic", "lexicographic", "sequence", "sequence"), ("lexicographic_quality", "lexicographic", "quality", "quality"), ("mean", "mean", "quality", "list_sum(c) // 64"), ("norm", "norm", "quality", "list_sum([x * x for x in c])"),
    ("mean_variance", "mean_variance", "quality", "list_sum(c) // 64, list_sum([(x - list_sum(c) // 64) * (x - list_sum(c) // 64) for x in c]) // 64"), ("mean_min", "mean_min", "quality", "list_sum(c) // 64, list_min(c)"),
    ("profile8", "profile8", "quality", "[list_sum(c[8 * b + 1 : 8 * b + 8]) // 8 for b in range(8)]"), ("profile16", "profile16", "quality", "[list_sum(c[4 * b + 1 : 4 * b + 4]) // 4 for b in range(16)]"),
    ("ends", "ends", "sequence", "concat(substr(sequence, 1, 16), right(sequence, 16))"), ("strand", "strand_lexicographic", "sequence", f"least(sequence, {_rc('sequence')})"), ("both", "lexicographic", "both", "sequence, quality"),
):
    _add(f"gr13_sort_{_n}", _ORDER.format(keys=_keys, source=f"(SELECT *, {_codes('quality')} AS c FROM reads)"), lambda r, s=_strategy, c=_column: reorder.by_strategy(r, s, c, 5000))
_add("gr13_sort_syncmer", _ORDER.format(keys="hash NULLS LAST", source="(SELECT r.read_idx, s.hash FROM reads r LEFT JOIN (SELECT read_idx, min(hash) AS hash FROM sy GROUP BY read_idx) s USING (read_idx))"), lambda r: reorder.by_strategy(r, "syncmer", "sequence", 5000), extra=_syncmer_cte())
_add("gr13_sort_minimizer", _ORDER.format(keys="hash NULLS LAST", source=f"(SELECT r.read_idx, s.hash FROM reads r LEFT JOIN (SELECT read_idx, min({_hash('kmer', 21)}) AS hash FROM km GROUP BY read_idx) s USING (read_idx))"), lambda r: reorder.by_strategy(r, "minimizer", "sequence", 5000), extra=_kmer_cte(21))
_add("gr14_block_order", _ORDER.replace("5000", "256").format(keys="quality", source="reads"), lambda r: reorder.in_blocks(r, "lexicographic", 256))
_VAR = "CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 ELSE 5 END"


def _bytes_sql(value: str, order: str) -> str:
    return f"(SELECT {_long(f'sum({_VAR})')} FROM (SELECT CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM (SELECT {value} - lag({value}, 1, 0) OVER (PARTITION BY chunk_id ORDER BY {order}) AS d FROM o)))"


_add("gr15_permutation_sizes", f"SELECT {_bytes_sql('read_idx', 'new_pos')} AS forward, {_bytes_sql('new_pos', 'read_idx')} AS inverse, 4 * count(*) AS raw, count(*) AS mean_key, 3 * count(*) AS mean_variance_key FROM o", lambda r: reorder.encoded_sizes(reorder.center(r, 5000)), extra=_GROUPED + f", o AS ({_ORDER.format(keys='g', source='grouped')})")
_COUNTS = _kmer_cte(15) + ", counts AS (SELECT kmer, least(count(*), 65535) AS count FROM km GROUP BY kmer)"
_add("gr16_template_seeds", "SELECT kmer, count FROM counts WHERE count >= 3 ORDER BY count DESC, kmer LIMIT 50000", lambda r: assembly.seeds(kmers.count_kmers(r, 15), 3, 50_000), extra=_COUNTS)
_FREQ = _syncmer_cte() + ", hashes AS (SELECT read_idx, min(hash) AS hash FROM sy GROUP BY read_idx), hc AS (SELECT hash, count(*) AS n FROM hashes GROUP BY hash), cc AS (SELECT n, count(*) AS values FROM hc GROUP BY n)"


def _frequency(k):
    return lambda r: kmers.frequency(r.select("read_idx", S.min_syncmer("sequence")["hash"].alias("hash")), "hash")[k]


_add("gr17_counts_of_counts", 'SELECT n, "values" FROM cc', _frequency(0), extra=_FREQ.replace("AS values", 'AS "values"'))
_add("gr17_coverage", f'SELECT n, "values", {_long(chr(34).join(["sum(", "values", ") OVER (ORDER BY n DESC)"]))} AS values_upto, {_long(chr(34).join(["sum(n * ", "values", ") OVER (ORDER BY n DESC)"]))} AS rows_upto FROM cc', _frequency(1), extra=_FREQ.replace("AS values", 'AS "values"'))
_add("gr17_most_frequent", "SELECT hash, n FROM hc ORDER BY n DESC, hash LIMIT 20", _frequency(2), extra=_FREQ.replace("AS values", 'AS "values"'))
_add("gr18_sort_closed_syncmer", None, lambda r: reorder.by_strategy(r, "closed_syncmer", "sequence", 5000))
_add("gr18_sort_sketch", _ORDER.format(keys="sketch[1] NULLS FIRST, sketch[2] NULLS FIRST, sketch[3] NULLS FIRST, sketch[4] NULLS FIRST", source=f"(SELECT r.read_idx, s.sketch FROM reads r LEFT JOIN (SELECT read_idx, list_sort(list(DISTINCT {_hash('kmer', 21)})) AS sketch FROM km GROUP BY read_idx) s USING (read_idx))"), lambda r: reorder.by_strategy(r, "sketch4", "sequence", 5000), extra=_kmer_cte(21))

for _kind, _k in [("closed", k) for k in (15, 21, 25, 31)] + [("open", k) for k in (15, 31)] + [("top2", 31), ("placed", 31), ("kmer", 15), ("kmer", 25)]:
    _found = _kmer_cte(_k) + f", sy AS (SELECT read_idx, pos, {_hash('kmer', _k)} AS hash FROM km)" if _kind == "kmer" else _syncmer_cte(_k, offsets=(0,) if _kind == "open" else (0, _k - 10))
    _keys = {"top2": "hs[1] NULLS LAST, hs[2] NULLS LAST", "placed": "hs[1] NULLS LAST, p NULLS LAST"}.get(_kind, "hs[1] NULLS LAST")
    _add(f"gr18_{_kind}_{_k}", _ORDER.format(keys=_keys, source="(SELECT r.read_idx, s.hs, s.p FROM reads r LEFT JOIN (SELECT read_idx, list_sort(list(DISTINCT hash)) AS hs, arg_min(pos, struct_pack(h := hash, p := pos)) AS p FROM sy GROUP BY read_idx) s USING (read_idx))"),
         lambda r, n=f"{_kind}:{_k}": reorder.by_strategy(r, n, "sequence", 5000), extra=_found)

_SQL["gr18_sort_closed_syncmer"] = _SQL["gr18_closed_31"]  # one key under two names

# ---- k-mers, graph, mapping ---------------------------------------------------------------------------

_add("as01_choose_k", f"SELECT {_long('sum(length(sequence))')} AS bases, CAST(CASE WHEN sum(length(sequence)) < 5000000 THEN 15 WHEN sum(length(sequence)) < 50000000 THEN 19 WHEN sum(length(sequence)) < 500000000 THEN 23 WHEN sum(length(sequence)) < 2000000000 THEN 27 ELSE 31 END AS BIGINT) AS k FROM reads", kmers.choose_k)
_add("as02_kmer_counts", "SELECT kmer, count FROM counts", lambda r: kmers.count_kmers(r, 15), extra=_COUNTS)
_add("as03_trim", "SELECT kmer, count FROM counts WHERE count > (SELECT CASE WHEN sum(CASE WHEN count = 1 THEN 1 ELSE 0 END) > 0.9 * count(*) THEN 0 ELSE 1 END FROM counts)", lambda r: kmers.trim(kmers.count_kmers(r, 15)), extra=_COUNTS)
_add("as04_neighbours", f"""SELECT n.kmer, n.side, n.base, n.next, c.count FROM (
  SELECT kmer, side, base, least(raw, {_rc('raw')}) AS next FROM (SELECT kmer, 'right' AS side, base, concat(substr(kmer, 2), base) AS raw FROM counts, (VALUES ('A'), ('C'), ('G'), ('T')) t(base)
    UNION ALL SELECT kmer, 'left', base, concat(base, substr(kmer, 1, 14)) FROM counts, (VALUES ('A'), ('C'), ('G'), ('T')) t(base))) n JOIN counts c ON c.kmer = n.next""", lambda r: kmers.neighbours(kmers.count_kmers(r, 15), 15), extra=_COUNTS)
_add("as05_unitigs", None, lambda r: assembly.unitigs(kmers.count_kmers(r, 15), 15))
_CONTIGS = ", contigs AS (SELECT read_idx AS contig_id, sequence FROM reads WHERE read_idx IN (SELECT min(read_idx) FROM reads GROUP BY sequence))"


def _contigs(r):
    return r.groupBy("sequence").agg(F.min("read_idx").alias("contig_id")).select("contig_id", "sequence")


_INDEX = _CONTIGS + f""", ix_raw AS (SELECT contig_id, CAST(i - 1 AS BIGINT) AS position, substr(sequence, i, 15) AS raw FROM contigs, unnest(range(1, length(sequence) - 13, 2)) t(i)),
  ix AS (SELECT least(raw, {_rc('raw')}) AS kmer, contig_id, position, raw <= {_rc('raw')} AS is_forward FROM ix_raw WHERE NOT regexp_matches(raw, '[^ACGT]'))"""
_add("as06_reference_index", "SELECT kmer, contig_id, position, is_forward FROM ix", lambda r: kmers.reference_index(_contigs(r), 15, 2), extra=_INDEX)
_add("as08_capped_postings", "SELECT kmer, contig_id, position, is_forward FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY contig_id, position) AS n FROM ix) WHERE n <= 2", lambda r: kmers.capped_postings(kmers.reference_index(_contigs(r), 15, 2), 2), extra=_INDEX)


_MAP = _CONTIGS + f""", idx AS (SELECT least(raw, {_rc('raw')}) AS kmer, contig_id, position, raw <= {_rc('raw')} AS is_forward FROM (SELECT contig_id, i - 1 AS position, substr(sequence, i, 15) AS raw FROM contigs, unnest(range(1, length(sequence) - 13)) t(i)) WHERE NOT regexp_matches(raw, '[^ACGT]')),
  seeds AS (SELECT read_idx, sequence, o AS offset_, raw, least(raw, {_rc('raw')}) AS kmer, raw <= {_rc('raw')} AS forward FROM (SELECT read_idx, sequence, o, substr(sequence, o + 1, 15) AS raw FROM mutated, unnest([0, 16, 32, 49]) t(o)) WHERE NOT regexp_matches(raw, '[^ACGT]')),
  placed AS (SELECT DISTINCT s.read_idx, s.sequence, i.contig_id, CASE WHEN s.forward <> i.is_forward THEN i.position - (64 - 15 - offset_) ELSE i.position - offset_ END AS position, s.forward <> i.is_forward AS is_rc FROM seeds s JOIN idx i USING (kmer)),
  scored AS (SELECT p.read_idx, p.contig_id, p.position, p.is_rc, len([1 for j in range(1, 65) if substr(CASE WHEN is_rc THEN {_rc('p.sequence')} ELSE p.sequence END, j, 1) <> substr(c.sequence, j, 1)]) AS distance
    FROM placed p JOIN contigs c USING (contig_id) WHERE p.position = 0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY distance, contig_id, position, is_rc) AS n FROM scored WHERE distance <= 8) WHERE n = 1)"""
_add("as07_map_reads", "SELECT m.read_idx, b.contig_id, CAST(b.position AS BIGINT) AS position, b.is_rc, CAST(b.distance AS BIGINT) AS distance FROM mutated m LEFT JOIN best b USING (read_idx)", None, extra=_MAP)
_QUERIES["as07_map_reads"] = lambda spark, sf: tidy(kmers.map_reads(R.derived_reads(spark, sf, True), _contigs(R.derived_reads(spark, sf)), 15))
_add("as09_reads_with_neighbours", "SELECT read_idx FROM mutated WHERE read_idx IN (SELECT read_idx FROM posts WHERE hash IN (SELECT hash FROM posts GROUP BY hash HAVING count(*) > 1))", lambda r: kmers.with_neighbours(r, 15, 11).select("read_idx"), mutated=True, extra=_EDGES)
_add("as09_isolated_reads", "SELECT read_idx FROM mutated WHERE read_idx NOT IN (SELECT read_idx FROM posts WHERE hash IN (SELECT hash FROM posts GROUP BY hash HAVING count(*) > 1))", lambda r: kmers.isolated(r, 15, 11).select("read_idx"), mutated=True, extra=_EDGES)


def _encode(spark, sf):
    reads, contigs = R.derived_reads(spark, sf, True), _contigs(R.derived_reads(spark, sf))
    return kmers.mapped_mismatches(kmers.map_reads(reads, contigs, 15), reads, contigs), contigs


_add("as12_mismatches", f"""SELECT m.read_idx, array_to_string([concat(j - 1, substr(m.sequence, j, 1)) for j in range(1, 65) if substr(m.sequence, j, 1) <> substr(CASE WHEN b.is_rc THEN {_rc('c.sequence')} ELSE c.sequence END, j, 1)], ',') AS mismatches
  FROM mutated m JOIN best b USING (read_idx) JOIN contigs c ON c.contig_id = b.contig_id""", None, extra=_MAP)
_QUERIES["as12_mismatches"] = lambda spark, sf: _encode(spark, sf)[0].filter("contig_id is not null").select("read_idx", F.array_join(F.transform("mismatches", lambda m: F.concat(m["pos"].cast("string"), m["base"])), ",").alias("mismatches"))
_add("as13_decode_mapped", "SELECT read_idx, sequence FROM mutated", None)
_QUERIES["as13_decode_mapped"] = lambda spark, sf: kmers.decode_mapped(*_encode(spark, sf))
_add("as15_hybrid_streams", f"""SELECT 'flags' AS stream, m.read_idx, CASE WHEN b.read_idx IS NULL THEN '0' ELSE '1' END AS data FROM mutated m LEFT JOIN best b USING (read_idx)
  UNION ALL SELECT 'singletons', read_idx, sequence FROM mutated WHERE read_idx NOT IN (SELECT read_idx FROM best)
  UNION ALL SELECT 'mapping', read_idx, concat(contig_id, ':', CAST(position AS BIGINT), ':', is_rc) FROM best
  UNION ALL SELECT 'positions', read_idx, array_to_string([p[i] - coalesce(p[i - 1], 0) for i in range(1, len(p) + 1)], ',') FROM apart
  UNION ALL SELECT 'bases', read_idx, array_to_string([substr(x, CAST(i + 1 AS INT), 1) for i in p], '') FROM apart
  UNION ALL SELECT 'consensus', contig_id, sequence FROM contigs""", None, extra=_MAP + f""", apart AS (SELECT read_idx, x, [j - 1 for j in range(1, 65) if substr(x, j, 1) <> substr(y, j, 1)] AS p FROM (
    SELECT m.read_idx, m.sequence AS x, CASE WHEN b.is_rc THEN {_rc('c.sequence')} ELSE c.sequence END AS y FROM mutated m JOIN best b USING (read_idx) JOIN contigs c ON c.contig_id = b.contig_id))""")
_QUERIES["as15_hybrid_streams"] = lambda spark, sf: tidy(kmers.hybrid_streams(*_encode(spark, sf)))
_MUTATED_COUNTS = _kmer_cte(15, "mutated") + ", counts AS (SELECT kmer, least(count(*), 65535) AS count FROM km GROUP BY kmer)"
_add("as14_corrected_kmers", f"""SELECT kmer, corrected FROM (SELECT e.kmer, c.kmer AS corrected, row_number() OVER (PARTITION BY e.kmer ORDER BY c.count DESC, c.kmer) AS n FROM (
  SELECT kmer, least(raw, {_rc('raw')}) AS other FROM (SELECT kmer, unnest([concat(substr(kmer, 1, 14), base), concat(base, substr(kmer, 2))]) AS raw FROM counts, (VALUES ('A'), ('C'), ('G'), ('T')) t(base) WHERE count < 2) WHERE raw <> kmer) e
  JOIN counts c ON c.kmer = e.other AND c.count >= 3) WHERE n = 1""", lambda r: assembly.correct_kmers(kmers.count_kmers(r, 15), k=15), mutated=True, extra=_MUTATED_COUNTS)
_add("as14_templates", None, lambda r: assembly.templates(keep(kmers.count_kmers(r, 15), "counts"), 15, 64))

# ---- entropy and models ---------------------------------------------------------------------------------


def _given(ctx: str, sym: str, source: str = "context") -> str:
    return f"""SELECT {_long('sum(t)')} AS n, round((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY {sym})), 6) AS h, round((sum(t * log2(t)) - sum(w)) / sum(t), 6) AS h_given,
  round((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY {sym})) - (sum(t * log2(t)) - sum(w)) / sum(t), 6) AS gain
  FROM (SELECT sum(n) AS t, sum(n * log2(n)) AS w FROM (SELECT {ctx}, count(*) AS n FROM {source} GROUP BY {ctx}, {sym}) GROUP BY {ctx})"""


_add("en01_quality_entropy", f"SELECT {_long('sum(n)')} AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM (SELECT count(*) AS n FROM bases GROUP BY phred)", lambda r: entropy.entropy(R.bases(r), "phred"), extra=_BASES)
_add("en02_quality_given_position", _given("pos", "phred", "bases"), lambda r: entropy.conditional_entropy(R.bases(r), ["pos"], "phred"), extra=_BASES)
_add("en02_quality_given_previous", _given("q1", "phred"), lambda r: entropy.conditional_entropy(_contexts(r), ["q1"], "phred"), extra=_CONTEXT)
_ENS = {"base": ["base"], "neighbours": ["b1", "n1"], "pos": ["pos"], "pos_base": ["base", "pos"], "pos_q1": ["pos", "q1"], "prev1": ["b1"], "prev2": ["b1", "b2"], "q1": ["q1"], "q1_q2": ["q1", "q2"]}


def _gain(cs) -> str:
    c = ", ".join(cs)
    return f"(SELECT (sum(t * log2(t)) - sum(w)) / sum(t) AS h_given, {_long('sum(t)')} AS n FROM (SELECT sum(n) AS t, sum(n * log2(n)) AS w FROM (SELECT {c}, count(*) AS n FROM context GROUP BY {c}, phred) GROUP BY {c}))"


_H = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT count(*) AS n FROM context GROUP BY phred))"
_add("en04_quality_contexts", "SELECT context, n, round(h, 6) AS h, round(h_given, 6) AS h_given, round(100 * (h - h_given) / h, 6) AS gain_pct, round((h - h_given) * n / 8, 1) AS saved_bytes FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS context, n, h, h_given FROM {_gain(cs)}, {_H}" for k, cs in _ENS.items()) + ")",
     lambda r: entropy.context_gains(_contexts(r), _ENS, "phred").withColumn("saved_bytes", F.round("saved_bytes", 1)), extra=_CONTEXT)
_add("en03_information_gain", _SQL["en04_quality_contexts"][len(_WITH) + len(_CONTEXT) + 1 :].replace("SELECT context, n, round(h, 6) AS h, round(h_given, 6) AS h_given, round(100", "SELECT context, round(h - h_given, 6) AS mutual_information, round(100").replace(", round((h - h_given) * n / 8, 1) AS saved_bytes", ""),
     lambda r: entropy.context_gains(_contexts(r), _ENS, "phred").select("context", (F.col("h") - F.col("h_given")).alias("mutual_information"), "gain_pct"), extra=_CONTEXT)
for _n, _ctx, _src in (("position", "pos", ""), ("previous", "b1", ""), ("previous2", "b1, b2", "b1 <> 'N' AND b2 <> 'N' AND "), ("quality", "phred", ""), ("quality_previous", "phred, b1", "")):
    _w = _src + "base <> 'N'"
    _add(f"en05_base_given_{_n}", _given(_ctx, "base", f"(SELECT * FROM context WHERE {_w})"), lambda r, c=_ctx, w=_w: entropy.conditional_entropy(_contexts(r).filter(w), c.split(", "), "base"), extra=_CONTEXT)
_add("en06_position_profile", "SELECT pos, count(*) AS n, round(avg(phred), 6) AS mean, round(sqrt(greatest(0, avg(phred * phred) - avg(phred) * avg(phred))), 6) AS std, round((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM bases b WHERE b.pos = bases.pos GROUP BY phred)), 6) AS h FROM bases GROUP BY pos", lambda r: entropy.position_profile(R.bases(r)), extra=_BASES)
_add("en07_quality_by_base", "SELECT base, count(*) AS n, round(avg(phred), 6) AS mean FROM bases GROUP BY base", lambda r: R.bases(r).groupBy("base").agg(F.count("*").alias("n"), F.avg("phred").alias("mean")), extra=_BASES)
_add("en08_adaptive_cost", _cost_sql("q1", "phred", 41), lambda r: _kbits(entropy.adaptive_cost(_contexts(r), ["q1"], "phred", 41)), extra=_CONTEXT)
_PRESETS = {"none": "0", "position": "pos // 5", "previous": "q1", "previous_bases": "q1 * 25 + (strpos('ACGTN', b1) - 1) * 5 + strpos('ACGTN', base) - 1"}
_SPARK_PRESETS = {"none": "0", "position": "pos div 5", "previous": "q1", "previous_bases": "q1 * 25 + (instr('ACGTN', b1) - 1) * 5 + instr('ACGTN', base) - 1"}
for _n, _e in _PRESETS.items():
    _add(f"en09_preset_{_n}", _cost_sql("ctx", "phred", 41, f"(SELECT *, CASE WHEN pos = 0 THEN 0 ELSE {_e} END AS ctx FROM context)"), lambda r, e=_SPARK_PRESETS[_n]: _kbits(entropy.adaptive_cost(_contexts(r).withColumn("ctx", F.expr(f"case when pos = 0 then 0 else {e} end")), ["ctx"], "phred", 41)), extra=_CONTEXT)
_add("en10_convergence", f"""SELECT "window", n, round(bits / n, 6) AS window_bits, round(sum(bits) OVER (ORDER BY "window") / sum(n) OVER (ORDER BY "window"), 6) AS total_bits FROM (SELECT read_idx // 1000 AS "window", count(*) AS n, sum(bits) AS bits FROM (SELECT read_idx, {_ADAPT.format(c='q1', s='phred', n=41)} AS bits FROM context) GROUP BY 1)""",
     lambda r: entropy.convergence(entropy.adaptive_cost_by_block(_contexts(r), ["q1"], "phred", 41, 1000)), extra=_CONTEXT)
_add("en11_occupancy", f"SELECT CAST(threshold AS BIGINT) AS threshold, count(*) AS contexts, {_long('sum(n)')} AS observations FROM (SELECT count(*) AS n FROM context GROUP BY pos, q1), (VALUES (1), (10), (100), (1000)) t(threshold) WHERE n >= threshold GROUP BY 1", lambda r: entropy.occupancy(_contexts(r), ["pos", "q1"], [1, 10, 100, 1000]), extra=_CONTEXT)
_add("en11_occupancy_median", "SELECT list_sort(list(n))[len(list(n)) // 2 + 1] AS median FROM (SELECT count(*) AS n FROM context GROUP BY pos, q1)", lambda r: entropy.occupancy_median(_contexts(r), ["pos", "q1"]), extra=_CONTEXT)
_NEXT = _kmer_cte(6) + ", nb AS (SELECT substr(raw, 1, 5) AS kmer, substr(raw, 6, 1) AS base, count(*) AS n FROM km GROUP BY 1, 2)"
_add("en12_next_base", "SELECT kmer, base, n FROM nb", lambda r: kmers.next_base_counts(r, 5), extra=_NEXT)
_add("en13_base_ranks", "SELECT kmer, base, n, row_number() OVER (PARTITION BY kmer ORDER BY n DESC, base) - 1 AS rank FROM nb", lambda r: kmers.base_ranks(kmers.next_base_counts(r, 5)), extra=_NEXT)
_add("en13_ranked_bases", """SELECT k.read_idx, k.pos + 5 AS pos, substr(k.raw, 6, 1) AS base, coalesce(rank, 4) AS rank FROM km_raw k
  LEFT JOIN (SELECT kmer, base, row_number() OVER (PARTITION BY kmer ORDER BY n DESC, base) - 1 AS rank FROM nb) r ON r.kmer = substr(k.raw, 1, 5) AND r.base = substr(k.raw, 6, 1)""", lambda r: kmers.rank_bases(r, 5), extra=_NEXT)
_add("en14_table_quality", f"SELECT {_long('sum(t)')} AS n, round((sum(t * log2(t)) - sum(w)) / sum(t), 6) AS h, round(sum(top) / sum(t), 6) AS accuracy FROM (SELECT sum(n) AS t, max(n) AS top, sum(n * log2(n)) AS w FROM nb GROUP BY kmer)", lambda r: kmers.table_quality(kmers.next_base_counts(r, 5)), extra=_NEXT)
_add("en14_table_cost", f"SELECT {_long('sum(n)')} AS n, round(sum(n * -log2(n / t)) / 1000, 3) AS kbits FROM (SELECT n, sum(n) OVER (PARTITION BY kmer) AS t FROM nb)", lambda r: kmers.table_cost(kmers.next_base_counts(r, 5), r, 5).select("n", F.round(F.col("bits") / 1000, 3).alias("kbits")), extra=_NEXT)
for _n, _sign in (("published", "-"), ("textbook", "+")):
    _add(f"en15_noise_entropy_{_n}", f"SELECT pos, round(p, 6) AS p, round(-(p * log2(p) + (1 - p) * log2(1 - p)) {_sign} p * log2(3), 6) AS h FROM (SELECT pos, avg(pow(10, -phred / 10.0)) AS p FROM bases GROUP BY pos)", lambda r, t=_n == "textbook": entropy.noise_entropy(R.bases(r), t), extra=_BASES)
_add("en16_quality_ngrams", f"SELECT cluster, pos, phred, next1, next2, count(*) AS n FROM (SELECT read_idx, pos, phred, lead(phred, 1) OVER w AS next1, lead(phred, 2) OVER w AS next2 FROM bases WINDOW w AS (PARTITION BY read_idx ORDER BY pos)) JOIN (SELECT read_idx, {_long(f'list_sum({_codes(chr(113) + chr(117) + chr(97) + chr(108) + chr(105) + chr(116) + chr(121))}) // 64 // 5')} AS cluster FROM reads) USING (read_idx) GROUP BY ALL", entropy.quality_ngrams, extra=_BASES)
_add("en17_length_histogram", "SELECT CAST(l AS BIGINT) AS length, count(read_idx) AS n FROM range(512) t(l) LEFT JOIN reads ON length(sequence) = l GROUP BY 1", entropy.length_histogram)
_add("en20_variance_explained", "SELECT round(1 - var_pop(phred - m) / var_pop(phred), 6) AS explained FROM (SELECT phred, avg(phred) OVER (PARTITION BY pos) AS m FROM bases)", lambda r: entropy.position_variance_explained(R.bases(r)), extra=_BASES)
_UP_SQL = "(SELECT *, lag(base, 1, 'S') OVER (PARTITION BY pos, read_idx // 5000 ORDER BY read_idx) AS up FROM bases)"


def _column_cost(r, limit, block):
    return _kbits(entropy.halving_cost(R.bases(consensus.above(r, 5000), False, beside=["up"]), ["pos", "up"], "base", 5, limit, block, prior=4, order=["read_idx"]))


_add("en21_column_context_cost", f"SELECT count(*) AS n, round(sum(bits) / 1000, 3) AS kbits FROM (SELECT -log2((4 + count(*) OVER (PARTITION BY read_idx // {BLOCK}, pos, up, base ORDER BY read_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / (20 + count(*) OVER (PARTITION BY read_idx // {BLOCK}, pos, up ORDER BY read_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS bits FROM {_UP_SQL})",
     lambda r: _column_cost(r, COLUMN_LIMIT, BLOCK), extra=_BASES)
_add("en21_halved_column_cost", _halving_sql("up, pos", "strpos('ACGTN', base) - 1", 5, 60, 2000, 4, _DOWN, _UP_SQL), lambda r: _column_cost(r, 60, 2000), extra=_BASES)

# ---- matrices and consensus -------------------------------------------------------------------------------

_TOP = _BASES + ", cons AS (SELECT pos, base, n FROM (SELECT pos, base, count(*) AS n, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, base DESC) AS k FROM bases WHERE base <> 'N' GROUP BY pos, base) WHERE k = 1)"
_add("mx01_transpose", "SELECT pos, read_idx // 65536 AS block, string_agg(base, '' ORDER BY read_idx) AS bases FROM bases GROUP BY 1, 2", lambda r: consensus.transpose(R.bases(r, False)).select("pos", "block", F.array_join("values", "").alias("bases")), extra=_BASES)
_add("mx02_consensus_last", "SELECT pos, base, n FROM cons", lambda r: consensus.column_consensus(R.bases(r, False)), extra=_TOP)
_add("mx02_consensus_first", "SELECT pos, base, n FROM (SELECT pos, base, count(*) AS n, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, base) AS k FROM bases WHERE base <> 'N' GROUP BY pos, base) WHERE k = 1", lambda r: consensus.column_consensus(R.bases(r, False), ties="first"), extra=_BASES)
_add("mx03_residual", "SELECT b.read_idx, b.pos, CAST((strpos('ACGT', b.base) - strpos('ACGT', c.base) + 4) % 4 AS BIGINT) AS residual FROM bases b JOIN cons c USING (pos) WHERE b.base <> 'N'", lambda r: (lambda b: consensus.residual(b, consensus.column_consensus(b)))(R.bases(r, False)), extra=_TOP)
_SHIFTS = _SQL["sq24_best_shift"][len(_WITH) + len(_kmer_cte(5, "mutated")) + 1 :]
_add("mx04_shift_residual", "SELECT m.read_idx, m.\"column\", CAST((strpos('ACGT', m.base) - strpos('ACGT', c.base) + 4) % 4 AS BIGINT) AS residual FROM moved m JOIN top c USING (\"column\") WHERE m.base <> 'N'",
     lambda r: consensus.shift_residual(R.bases(r, False), consensus.best_shift(r, 0, 5)), mutated=True, extra=_kmer_cte(5, "mutated") + f""", shifts AS ({_SHIFTS}),
  moved AS (SELECT s.read_idx, CAST(i - 1 + s.shift - (SELECT min(shift) FROM shifts) AS BIGINT) AS "column", substr(m.sequence, i, 1) AS base FROM mutated m JOIN shifts s USING (read_idx), unnest(range(1, 65)) t(i)),
  top AS (SELECT "column", base FROM (SELECT "column", base, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, base DESC) AS k FROM moved WHERE base <> 'N' GROUP BY "column", base) WHERE k = 1)""")
_add("mx05_mod4_delta", "SELECT read_idx, pos, CAST((c - lag(c, 1, 0) OVER (PARTITION BY pos ORDER BY read_idx) + 4) % 4 AS BIGINT) AS step FROM (SELECT read_idx, pos, strpos('ACGT', base) - 1 AS c FROM bases WHERE base <> 'N')", lambda r: consensus.by_base(consensus.mod4_delta(r), "steps", "step").filter("step <> 'N'").withColumn("step", F.col("step").cast("long")), extra=_BASES)
_add("mx05_mod4_undelta", "SELECT read_idx, pos, base FROM bases WHERE base <> 'N'", lambda r: consensus.by_base(consensus.mod4_undelta(consensus.mod4_delta(r)), "sequence", "base").filter("base <> 'N'"), extra=_BASES)
_add("mx06_previous_base_delta", "SELECT read_idx, pos, CASE WHEN base = lag(base) OVER (PARTITION BY pos ORDER BY read_idx) THEN '0' ELSE base END AS delta FROM bases", lambda r: consensus.by_base(consensus.previous_base_delta(r), "deltas", "delta"), extra=_BASES)
for _n in (4, 16):
    _add(f"mx07_interleave_{_n}", f'SELECT read_idx // {_n} AS cluster, pos, read_idx % {_n} AS "row", base, row_number() OVER (PARTITION BY read_idx // {_n} ORDER BY pos, read_idx) - 1 AS new_pos FROM bases', lambda r, n=_n: consensus.interleave(R.bases(r, False), n), extra=_BASES)
_RANKED = "SELECT read_idx, pos, row_number_ AS rank FROM (SELECT * FROM ctxs JOIN (SELECT bin, context, base, row_number() OVER (PARTITION BY bin, context ORDER BY count(*) DESC, base) - 1 AS row_number_ FROM ctxs GROUP BY bin, context, base) USING (bin, context, base))"


def _before(r, k):
    """Bases with the ``k`` before them, of which a read's first bases have fewer."""
    return R.bases(r, False, context=[f"b{i}" for i in range(1, k + 1)]).withColumn("context", F.concat(*[F.when(F.col("pos") >= i, F.col(f"b{i}")).otherwise("") for i in range(k, 0, -1)]))


_add("mx08_rank_by_position", _RANKED, lambda r: consensus.rank_by_position(R.bases(r, False), r.select("read_idx", F.length("sequence").alias("length"))), extra=_BASES + ", ctxs AS (SELECT b.read_idx, pos, base, least(pos * 5 // 64, 4) AS bin, substr(r.sequence, greatest(1, CAST(pos - 1 AS BIGINT)), least(2, pos)) AS context FROM bases b JOIN reads r USING (read_idx))")
_add("mx08_rank_mixed_order", _RANKED, lambda r: consensus.rank_mixed_order(_before(r, 4), 4), extra=_BASES + ", ctxs AS (SELECT b.read_idx, pos, base, 0 AS bin, substr(r.sequence, greatest(1, CAST(pos - 3 AS BIGINT)), least(4, pos)) AS context FROM bases b JOIN reads r USING (read_idx))")

# ---- pairs and chains ---------------------------------------------------------------------------------------

def _chain(spark, sf_dir):
    path = _file(spark)
    chain.write_chain(R.derived_reads(spark, sf_dir, True), path)
    return tidy(chain.read_chain(spark, path))


_add("sp01_chain_round_trip", "SELECT read_idx, id, sequence, quality FROM mutated", None)
_QUERIES["sp01_chain_round_trip"] = _chain
_add("sp02_preprocess", "SELECT read_idx, read_idx // 256 AS block, sequence, contains(sequence, 'N') AS has_n FROM reads", lambda r: pairs.preprocess(r, 256))
_add("sp03_window_dictionaries", "SELECT side, \"window\", count(*) AS reads, min(read_idx) AS first FROM (SELECT read_idx, 'left' AS side, substr(sequence, 1, 32) AS \"window\" FROM reads UNION ALL SELECT read_idx, 'right', substr(sequence, 33, 32) FROM reads) GROUP BY 1, 2", pairs.window_dictionaries)
_add("sp04_match_candidates", f"""SELECT a, b, is_rc, shift, distance FROM (SELECT a.read_idx AS a, b.read_idx AS b, a.is_rc, a.shift, {_long("len([1 for j in range(1, 65 - a.shift) if substr(a.s, j + a.shift, 1) <> substr(b.sequence, j, 1)])")} AS distance
  FROM (SELECT *, substr(s, CAST(13 + shift AS INT), 20) AS w FROM (SELECT read_idx, sequence AS s, false AS is_rc FROM mutated UNION ALL SELECT read_idx, {_rc('sequence')}, true FROM mutated), (SELECT CAST(v AS INT) AS shift FROM range(32) t(v))) a
  JOIN mutated b ON a.w = substr(b.sequence, 13, 20) AND a.read_idx <> b.read_idx AND (a.shift > 0 OR a.read_idx < b.read_idx)) WHERE distance <= 4""", pairs.match_candidates, mutated=True)
_add("sp05_rolling_consensus", f"""SELECT read_idx, string_agg(t, '' ORDER BY pos) AS consensus, {_long("sum(CASE WHEN t <> base THEN 1 ELSE 0 END)")} AS distance FROM (
  SELECT read_idx, pos, base, CASE WHEN ca >= cc AND ca >= ct AND ca >= cg THEN 'A' WHEN cc >= ct AND cc >= cg THEN 'C' WHEN ct >= cg THEN 'T' ELSE 'G' END AS t FROM (
    SELECT read_idx, pos, base, {", ".join(f"count(*) FILTER (base = '{x.upper()}') OVER w AS c{x}" for x in "acgt")} FROM (SELECT m.read_idx, i AS pos, substr(m.sequence, i, 1) AS base, substr(m.sequence, 20, 24) AS chain FROM mutated m, unnest(range(1, 65)) t(i))
    WINDOW w AS (PARTITION BY chain, pos ORDER BY read_idx ROWS UNBOUNDED PRECEDING))) GROUP BY read_idx""",
     lambda r: pairs.rolling_consensus(r, r.withColumn("__w", F.substring("sequence", 20, 24)).select(F.xxhash64("__w").alias("chain"), F.col("read_idx").alias("rank"), "read_idx")), mutated=True)
_add("sp07_restore_order", "SELECT read_idx, id FROM reads", lambda r: reorder.apply(r, reorder.center(r, 5000)).select("read_idx", "id"))
_HALF = f", o AS ({_ORDER.replace('5000', '1000000000').format(keys='quality', source='reads')}), h AS (SELECT count(*) // 2 AS n FROM reads), p AS (SELECT read_idx, row_number() OVER (ORDER BY new_pos) - 1 AS place, n FROM o, h WHERE read_idx < n)"
_add("sp08_pair_order", "SELECT read_idx, place FROM p UNION ALL SELECT read_idx + n, place + n FROM p", lambda r: pairs.pair_order(reorder.by_strategy(r, "lexicographic", "quality", None), r.count() // 2), extra=_HALF)
_add("sp09_pair_flags", f"""SELECT a.read_idx, CAST(CASE WHEN a.contig_id IS NOT NULL AND b.contig_id IS NOT NULL AND abs(b.position - a.position) < 32767 AND a.is_rc <> b.is_rc THEN 0 WHEN a.contig_id IS NOT NULL AND b.contig_id IS NOT NULL THEN 1
  WHEN a.contig_id IS NOT NULL THEN 2 WHEN b.contig_id IS NOT NULL THEN 3 ELSE 4 END AS BIGINT) AS flag
  FROM (SELECT m.read_idx, t.contig_id, t.position, t.is_rc FROM mutated m LEFT JOIN best t USING (read_idx)) a JOIN (SELECT m.read_idx - (SELECT count(*) // 2 FROM reads) AS read_idx, t.contig_id, t.position, t.is_rc FROM mutated m LEFT JOIN best t USING (read_idx)) b USING (read_idx)
  WHERE a.read_idx < (SELECT count(*) // 2 FROM reads)""", None, extra=_MAP)


def _pair_flags(spark, sf):
    reads = R.derived_reads(spark, sf, True)
    mapped = kmers.map_reads(reads, _contigs(R.derived_reads(spark, sf)), 15)
    return tidy(pairs.pair_flags(pairs.mapped_pairs(mapped, reads.count() // 2)).select("read_idx", "flag"))


_QUERIES["sp09_pair_flags"] = _pair_flags


def _decode_reads(spark, sf):
    encoded, contigs = _encode(spark, sf)
    mapped = encoded.filter("contig_id is not null")
    noise = mapped.select("read_idx", F.explode("mismatches").alias("m")).select("read_idx", "m.pos", "m.base")
    return tidy(pairs.decode_reads(contigs, pairs.absolute_positions(contigs, mapped), noise))


_add("sp06_singleton_alignment", "SELECT read_idx, contig_id, CAST(position AS BIGINT) AS position, is_rc, CAST(distance AS BIGINT) AS distance FROM best24", None,
     extra=_MAP + ", best24 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY distance, contig_id, position, is_rc) AS n FROM scored WHERE distance <= 24) WHERE n = 1)")
_QUERIES["sp06_singleton_alignment"] = lambda spark, sf: tidy(pairs.singleton_alignment(R.derived_reads(spark, sf, True), _contigs(R.derived_reads(spark, sf))))
_add("sp12_decode_reads", "SELECT m.read_idx, m.sequence FROM mutated m JOIN best b USING (read_idx)", None, extra=_MAP)
_QUERIES["sp12_decode_reads"] = _decode_reads
_add("sp10_quality_transitions", "SELECT pos, q1 AS before, phred, count(*) AS n FROM context GROUP BY 1, 2, 3", lambda r: pairs.quality_transitions(_contexts(r)), extra=_CONTEXT)
_add("sp10_quantized", None, lambda r: pairs.quantize_reads(r, pairs.quality_codebook(pairs.quality_transitions(_contexts(r)), 1.5)))
_add("sp11_threshold", f"SELECT read_idx, array_to_string([chr(CAST(33 + CASE WHEN x - 33 >= 30 THEN 35 ELSE 10 END AS INT)) for x in {_codes('quality')}], '') AS quality FROM reads", lambda r: r.select("read_idx", Q.threshold("quality", 30, 35, 10).alias("quality")))
_add("ql15_model_row", f"SELECT CAST(count(*) AS BIGINT) AS read_length, string_agg(CAST(median AS VARCHAR), ',' ORDER BY pos) AS medians FROM model", lambda r: delta.model_row(delta.quality_model(r)).select("read_length", F.array_join(F.transform("medians", lambda x: x.cast("string")), ",").alias("medians")), extra=_MODEL)
_add("ql15_model_read_back", "SELECT pos, median FROM model", lambda r: delta.model_table(delta.model_row(delta.quality_model(r))), extra=_MODEL)
_add("ql19_quality_codec", "SELECT CASE WHEN count(*) >= 100000 THEN 'context' ELSE 'plain' END AS codec FROM reads", None)
_QUERIES["ql19_quality_codec"] = lambda spark, sf: spark.createDataFrame([(api.choose_quality_codec(R.derived_reads(spark, sf)),)], "codec string")
_add("ql21_dictionary_sample", "SELECT read_idx, quality FROM reads, (SELECT n // most AS step, most FROM (SELECT count(*) AS n, least(greatest(CAST(ceil(count(*) * 0.1) AS BIGINT), 100), count(*)) AS most FROM reads)) WHERE read_idx % step = 0 AND read_idx < step * most", delta.dictionary_sample)
_add("ql21_least_sample", "SELECT read_idx, quality FROM reads WHERE read_idx < 100", lambda r: delta.dictionary_sample(r.filter("read_idx < 150")))
_LETTERS = sorted({ord(c) - 33 for c in "#,5:<>?BDFGHI"})
# the largest count, and of equal ones the smallest score, as one number
_add("ql25_prediction_residual", f"""SELECT read_idx, pos, CAST(phred - CASE WHEN g < 1000 THEN 0 ELSE 99 - g % 1000 END + 128 AS BIGINT) AS residual FROM (SELECT read_idx, pos, phred, greatest({", ".join(f"1000 * c{x} + {99 - x}" for x in _LETTERS)}) AS g
  FROM (SELECT read_idx, pos, phred, {", ".join(f"sum(CASE WHEN phred = {x} THEN 1 ELSE 0 END) OVER w - CASE WHEN phred = {x} THEN 1 ELSE 0 END AS c{x}" for x in _LETTERS)} FROM context WINDOW w AS (PARTITION BY q1, read_idx // 500000 ORDER BY read_idx, pos ROWS UNBOUNDED PRECEDING)))""", lambda r: delta.prediction_residual(R.bases(r, context=["q1"]), ["q1"]), extra=_CONTEXT)
_AS10 = ", shifted AS (SELECT read_idx, substr(sequence, CAST(read_idx % 3 * 8 + 1 AS INT), 48) AS sequence FROM reads)" + _kmer_cte(15, "shifted") + _LISTS + f""", picked AS (SELECT k.*, k.raw = k.kmer AS forward, s.sequence FROM (SELECT *, {_hash('kmer', 15)} AS hash FROM km) k SEMI JOIN posts USING (hash, read_idx) JOIN shifted s USING (read_idx)),
  few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY read_idx, pos) AS n FROM picked) WHERE n <= 200),
  met AS (SELECT DISTINCT a.read_idx AS a, b.read_idx AS b, a.forward <> b.forward AS is_rc, a.pos - CASE WHEN a.forward <> b.forward THEN 48 - b.pos - 15 ELSE b.pos END AS shift, a.sequence AS x, CASE WHEN a.forward <> b.forward THEN {_rc('b.sequence')} ELSE b.sequence END AS y FROM few a JOIN few b ON a.hash = b.hash AND a.read_idx <> b.read_idx),
  parts AS (SELECT a, b, is_rc, shift, 48 - abs(shift) AS overlap, CASE WHEN shift > 0 THEN substr(x, shift + 1) ELSE substr(x, 1, 48 + shift) END AS u, CASE WHEN shift > 0 THEN substr(y, 1, 48 - shift) ELSE substr(y, 1 - shift) END AS v FROM met WHERE shift <> 0 AND abs(shift) <= 17),
  apart AS (SELECT *, {_long("len([1 for j in range(1, overlap + 1) if substr(u, j, 1) <> substr(v, j, 1)])")} AS distance FROM parts)"""
_add("as10_overlap_candidates", f"SELECT a, b, is_rc, {_long('shift')} AS shift, {_long('overlap')} AS overlap, distance FROM apart WHERE distance <= 4", lambda r: kmers.overlap_candidates(_shifted(r), 15, 11, 31, 4), extra=_AS10)
_add("as14_tips", None, lambda r: (lambda c: assembly.extend_tips(assembly.templates(c.filter("count >= 2"), 15, 64), c, 15))(keep(kmers.count_kmers(r, 15), "counts")), mutated=True)
_add("as11_greedy_contigs", None, lambda r: assembly.greedy_contigs(_shifted(r), clusters.clusters(_shifted(r), "selective", 15, 11)))


def _shifted(r):
    """48-base windows of the reads at 0, 8 and 16, so that reads overlap."""
    return r.withColumn("sequence", F.substring("sequence", (F.col("read_idx") % 3 * 8 + 1).cast("int"), F.lit(48)))


def _svd(spark, sf):
    from ..operators import tensors

    ranks = tensors.svd_ranks(R.derived_reads(spark, sf), 64)
    return spark.createDataFrame([(float(s), int(k)) for s, k in ranks.items()], "share double, rank long")


def _tensors(spark, sf):
    from ..operators import tensors

    return tidy(spark.createDataFrame(tensors.decompositions(R.derived_reads(spark, sf), 64)))


_QUERIES["en18_svd_ranks"] = _svd
_QUERIES["en19_tensor_decompositions"] = _tensors
