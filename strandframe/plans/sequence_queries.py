"""Sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alphabet import COMPLEMENT_COMPAT, COMPLEMENT_STANDARD, codons, union_symbols
from ..operators import profile, sequence as sq
from .bridge import view, with_
from .registry import query

C, S = COMPLEMENT_COMPAT, COMPLEMENT_STANDARD
BASES = "list_value('A', 'C', 'G', 'T', 'N', '-')"


def _codes(table: str) -> str:
    c = codons(table)
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in c.items()) + "}"


@query("SEQ01_complement", with_("seqs", f"SELECT doc_id, translate(seq, '{C[0]}', '{C[1]}') AS compat, translate(seq, '{S[0]}', '{S[1]}') AS standard FROM seqs"))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", sq.complement(F.col("seq")).alias("compat"), sq.complement(F.col("seq"), "standard").alias("standard"))


@query("SEQ02_reverse_complement", with_("seqs", f"SELECT doc_id, reverse(translate(seq, '{C[0]}', '{C[1]}')) AS rc FROM seqs"))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("SEQ03_degap", with_("seqs", "SELECT doc_id, replace(seq, '-', '') AS degapped FROM seqs"))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", sq.degap(F.col("seq")).alias("degapped"))


@query("SEQ04_case", with_("seqs", "SELECT doc_id, lower(seq) AS low, upper(lower(seq)) AS up FROM seqs"))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", F.lower("seq").alias("low"), F.upper(F.lower("seq")).alias("up"))


def _translation(table: str, last: int) -> str:
    return f"""SELECT doc_id, CASE WHEN p IS NULL THEN '' ELSE split_part(p, '*', 1) END AS protein FROM (
      SELECT doc_id, array_to_string(list_transform(range(0, greatest(length(seq) - {last}, 0), 3), lambda i: coalesce({_codes(table)}[upper(substr(seq, i + 1, 3))], 'X')), '') AS p FROM seqs)"""


@query("SEQ06_translate", with_("seqs", _translation("compat", 3)))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", sq.translate(F.col("seq")).alias("protein"))


@query("SEQ06_translate_standard", with_("seqs", _translation("standard", 2)))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", sq.translate(F.col("seq"), table="standard", include_last=True).alias("protein"))


@query("SEQ07_restriction_sites", with_("seqs", """SELECT doc_id, CAST(len(p) AS INT) AS n, CAST(p[1] AS INT) AS first_pos FROM (SELECT doc_id,
  list_filter(range(0, greatest(length(seq) - 6, 0)), lambda i: regexp_matches(substr(seq, i + 1, 6), '^[RGA][RGA][HACT]TC[YTC]$')) AS p FROM seqs)"""))  # fmt: skip
def _(s, d):
    found = sq.restriction_sites(F.col("seq"), "RRHTCY")
    got = view(s, d, "seqs").select("doc_id", F.transform(F.array(found), lambda x: F.struct(F.size(x).alias("n"), F.get(x, 0)["pos"].alias("first_pos")))[0].alias("r"))
    return got.select("doc_id", "r.n", "r.first_pos")


@query("SEQ07_sites_with_mismatch", with_("seqs", """SELECT doc_id, i AS pos, m AS mismatches FROM (SELECT doc_id, CAST(i AS INT) AS i,
  CAST((substr(seq, i + 1, 1) <> 'G')::INT + (substr(seq, i + 2, 1) <> 'A')::INT + (substr(seq, i + 3, 1) <> 'T')::INT + (substr(seq, i + 4, 1) <> 'T')::INT + (substr(seq, i + 5, 1) <> 'A')::INT
   + (substr(seq, i + 6, 1) <> 'C')::INT + (substr(seq, i + 7, 1) <> 'A')::INT + (substr(seq, i + 8, 1) <> 'G')::INT AS INT) AS m
  FROM (SELECT doc_id, seq, unnest(range(0, greatest(length(seq) - 7, 0))) AS i FROM seqs)) WHERE m <= 1"""))  # fmt: skip
def _(s, d):
    found = sq.restriction_sites(F.col("seq"), "GATTACAG", max_unmatches=1, inclusive=True)
    return view(s, d, "seqs").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.pos", "x.mismatches")


@query("SEQ08_gaps", with_("seqs", """SELECT doc_id, CAST(min(i) - 1 AS INT) AS start, CAST(count(*) AS INT) AS extent FROM (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS i, seq FROM seqs) WHERE substr(seq, i, 1) = '-') GROUP BY doc_id, g"""))  # fmt: skip
def _(s, d):
    return view(s, d, "seqs").select("doc_id", F.explode(sq.gaps(F.col("seq"))).alias("x")).select("doc_id", "x.start", "x.extent")


@query("SEQ09_relative_position", with_("msa", "SELECT ord, CAST(p AS INT) AS pos, CAST(length(replace(substr(seq, 1, p + 1), '-', '')) - 1 AS INT) AS rel FROM msa, range(0, 67) r(p)"))
def _(s, d):
    at = view(s, d, "msa").select("ord", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"))
    return at.select("ord", "pos", sq.relative_position(F.col("seq"), F.col("pos")).alias("rel"))


@query("SEQ10_absolute_position", with_("msa", "SELECT ord, CAST(i - 1 AS INT) AS absolute FROM (SELECT ord, i, row_number() OVER (PARTITION BY ord ORDER BY i) AS k FROM (SELECT ord, seq, unnest(range(1, length(seq) + 1)) AS i FROM msa) WHERE substr(seq, i, 1) <> '-') WHERE k = 11"))
def _(s, d):
    return view(s, d, "msa").select("ord", sq.absolute_position(F.col("seq"), 10).alias("absolute")).filter("absolute IS NOT NULL")


@query("SEQ11_edit", with_("msa", "SELECT ord, substr(seq, 1, 4) || 'ACG' || substr(seq, 7) AS seq, seq || 'TT' AS longer, substr(seq, 3, 5) AS part FROM msa"))
def _(s, d):
    return view(s, d, "msa").select("ord", sq.edited(F.col("seq"), at=4, insert="ACG", delete=2).alias("seq"), F.concat("seq", F.lit("TT")).alias("longer"), F.substring("seq", 3, 5).alias("part"))


@query("SEQ13_attribute_append", "SELECT s_suppkey, replace('isolate %isolate', '%isolate', s_name) AS definition, 'src=' || s_name AS src FROM supplier")
def _(s, d):
    t = s.read.parquet(f"{d}/supplier.parquet")
    attrs = F.map_concat(F.create_map(F.lit("isolate"), F.col("s_name")), F.create_map(F.lit("src"), F.col("s_name")))
    return t.select("s_suppkey", F.replace(F.lit("isolate %isolate"), F.lit("%isolate"), attrs["isolate"]).alias("definition"), F.concat(F.lit("src="), attrs["src"]).alias("src"))


@query("SEQ14_accession", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '|x' END AS label FROM customer")
def _(s, d):
    t = s.read.parquet(f"{d}/customer.parquet")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("gi|1|gb|"), F.col("c_name"), F.lit("|"))).otherwise(F.concat(F.col("c_name"), F.lit("|x")))
    return t.select("c_custkey", sq.accession(raw).alias("label"))


@query("SEQ15_year", "SELECT doc_id, CASE WHEN regexp_extract(text, '([0-9]{4})', 1) = '' THEN '-' ELSE regexp_extract(text, '([0-9]{4})', 1) END AS year FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", sq.year_of(F.col("text")).alias("year"))


@query("SEQ16_attribute_line", "SELECT n_nationkey, '[name=' || n_name || '; region=' || n_regionkey || ']' AS line FROM nation")
def _(s, d):
    t = s.read.parquet(f"{d}/nation.parquet")
    return t.select("n_nationkey", sq.build_attributes(F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))).alias("line"))


@query("SEQ17_run_code", with_("msa", """SELECT ord, string_agg(n || m, '' ORDER BY lo) AS code FROM (SELECT ord, m, count(*) AS n, min(i) AS lo FROM (
  SELECT ord, i, m, i - row_number() OVER (PARTITION BY ord, m ORDER BY i) AS g FROM (SELECT ord, i, CASE WHEN substr(seq, i, 1) = '-' THEN 'D' WHEN substr(seq, i, 1) = 'N' THEN 'I' ELSE 'M' END AS m
  FROM (SELECT ord, seq, unnest(range(1, length(seq) + 1)) AS i FROM msa))) GROUP BY ord, m, g) GROUP BY ord"""))  # fmt: skip
def _(s, d):
    moves = F.translate("seq", "-NACGTR", "DIMMMMM")
    return view(s, d, "msa").select("ord", sq.run_code(moves).alias("code"))


_PIECES = "WITH p AS (SELECT ord, k, substr(translate(seq, 'NR', '--'), k * 23 + 1, 23) AS h FROM (SELECT ord, seq, unnest(range(0, (length(seq) + 22) // 23)) AS k FROM msa))"


def _pieces(s, d):
    """Haplotypes of 23 columns, which a number holds, one after another over the whole alignment."""
    v = view(s, d, "msa").withColumn("h", F.translate("seq", "NR", "--"))
    return v.select("ord", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("h") - 1) / 23)), lambda k: F.substr("h", (k * 23 + 1).cast("int"), F.lit(23)))).alias("k", "h")).withColumn("k", F.col("k").cast("long"))


@query("SEQ19_encode_haplotype", with_("msa", f"{_PIECES} SELECT ord, k, CAST(list_sum(list_transform(range(1, length(h) + 1), lambda i: (strpos('-ACGT', substr(h, i, 1)) - 1) * CAST(pow(5, length(h) - i) AS BIGINT))) AS BIGINT) AS code FROM p"))
def _(s, d):
    return _pieces(s, d).select("ord", "k", sq.encode_haplotype(F.col("h")).alias("code"))


@query("SEQ20_decode_haplotype", with_("msa", f"{_PIECES} SELECT ord, k, h AS haplotype FROM p"))
def _(s, d):
    p = _pieces(s, d).withColumn("code", sq.encode_haplotype(F.col("h")))
    return p.select("ord", "k", F.when(F.length("h") == 23, sq.decode_haplotype(F.col("code"), 23)).otherwise(sq.decode_haplotype(F.col("code"), 21)).alias("haplotype"))


@query("SEQ21_mhap_columns", with_("variants", "SELECT mhapidx, chrom, chrom || ':' || pos AS first_col, len(list_value(pos)) + (CASE WHEN pos % 2 = 0 THEN 2 ELSE 0 END) AS n_cols, chrom || ':' || (pos + (CASE WHEN pos % 2 = 0 THEN 9 ELSE 0 END)) AS last_col FROM variants"))
def _(s, d):
    code = F.concat_ws(":", "chrom", "pos", F.when(F.col("pos") % 2 == 0, F.lit("4,9")))
    return view(s, d, "variants").select("mhapidx", "chrom", sq.mhap_columns(code).alias("c")).select("mhapidx", "chrom", F.col("c")[0].alias("first_col"), F.size("c").cast("long").alias("n_cols"), F.element_at("c", -1).alias("last_col"))


@query("SRC03_definition_line", "SELECT s_suppkey, s_name AS label, CAST(s_nationkey AS VARCHAR) AS nation, 'of ' || s_name AS definition FROM supplier")
def _(s, d):
    line = F.concat(F.col("s_name"), F.lit(" [nation="), F.col("s_nationkey"), F.lit("; flag; bal=x] of "), F.col("s_name"))
    parts = sq.parse_definition(line)
    return s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", parts["label"].alias("label"), parts["attr"]["nation"].alias("nation"), parts["definition"].alias("definition"))


@query("FIL01_length_and_n", with_("seqs", "SELECT doc_id, CAST(length(seq) AS INT) AS len FROM seqs WHERE length(seq) >= 100 AND length(seq) <= 5000 AND (length(seq) - length(replace(seq, 'N', ''))) / length(seq) <= 0.06"))
def _(s, d):
    return sq.length_filter(view(s, d, "seqs"), minlen=100, maxlen=5000, max_n=0.06).select("doc_id", F.length("seq").alias("len"))


@query("FIL02_deflate", with_("seqs", "SELECT doc_id FROM seqs WHERE length(replace(seq, '-', '')) > 0"))
def _(s, d):
    return sq.deflate(view(s, d, "seqs")).select("doc_id")


@query("FIL03_shrink_gaps", with_("msa", "WITH long AS (SELECT ord, i, substr(seq, i, 1) AS b FROM (SELECT ord, seq, unnest(range(1, length(seq) + 1)) AS i FROM msa)), keep AS (SELECT i FROM long GROUP BY i HAVING max(CASE WHEN b <> '-' THEN 1 ELSE 0 END) = 1) SELECT ord, string_agg(b, '' ORDER BY i) AS seq FROM long JOIN keep USING (i) GROUP BY ord"))
def _(s, d):
    return sq.shrink_gaps(view(s, d, "msa"))


@query("FIL04_condense", with_("aligned", "WITH long AS (SELECT ord, i, substr(seq, i, 1) AS b FROM (SELECT ord, seq, unnest(range(1, length(seq) + 1)) AS i FROM aligned)), head AS (SELECT i, b AS r FROM long WHERE ord = (SELECT min(ord) FROM aligned)), keep AS (SELECT i FROM long JOIN head USING (i) WHERE upper(b) <> upper(r) AND b NOT IN ('N', 'n') GROUP BY i) SELECT ord, string_agg(b, '' ORDER BY i) AS seq FROM long JOIN keep USING (i) GROUP BY ord"))
def _(s, d):
    return sq.condense(view(s, d, "aligned"))[0]


@query("AGG01_composition", with_("seqs", "SELECT doc_id, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS INT) AS n_{n}" for b, n in zip("ACGTN-", ("a", "c", "g", "t", "n", "gap"), strict=True)) + ", CAST(length(seq) - length(regexp_replace(seq, '[ACGTN-]', '', 'g')) AS INT) AS len FROM seqs"))
def _(s, d):
    n = sq.composition(F.col("seq"))
    return view(s, d, "seqs").select("doc_id", *[n[b].alias(f"n_{x}") for b, x in zip("ACGTN-", ("a", "c", "g", "t", "n", "gap"), strict=True)], sum(n.values(), F.lit(0)).alias("len"))


@query("AGG02_summary", with_("seqs", "SELECT " + ", ".join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS n_{n}" for b, n in zip("ACGT-", ("a", "c", "g", "t", "gap"), strict=True)) + " FROM seqs"))
def _(s, d):
    n = sq.composition(F.col("seq"), ("A", "C", "G", "T", "-"))
    return view(s, d, "seqs").agg(*[F.sum(n[b]).alias(f"n_{x}") for b, x in zip("ACGT-", ("a", "c", "g", "t", "gap"), strict=True)])


@query("AGG03_dereplicate", with_("seqs", "SELECT string_agg(label, '#' ORDER BY doc_id) AS label, min(doc_id) AS ord, count(*) AS n FROM seqs GROUP BY seq"))
def _(s, d):
    return sq.dereplicate(view(s, d, "seqs").withColumnRenamed("doc_id", "ord")).select("label", "ord", "n")


@query("AGG04_deduplicate", with_("seqs", "SELECT min(doc_id) AS ord, source AS label FROM seqs GROUP BY source"))
def _(s, d):
    return sq.deduplicate(view(s, d, "seqs").select(F.col("doc_id").alias("ord"), F.col("source").alias("label"), "seq")).select("ord", "label")


@query("AGG05_haplotypes", with_("seqs", "SELECT sha256(seq) AS digest, count(*) AS n, min(doc_id) AS first_ord FROM seqs GROUP BY 1"))
def _(s, d):
    return sq.haplotype_clusters(view(s, d, "seqs").withColumnRenamed("doc_id", "ord"))


@query("AGG06_sequence_type", with_("seqs", """WITH r AS (SELECT lower(seq) AS q, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM seqs),
  p AS (SELECT length(regexp_replace(q, '[^acgt]', '', 'g')) / nullif(length(regexp_replace(q, '[-~]', '', 'g')), 0) AS dna, length(regexp_replace(q, '[^acgu]', '', 'g')) / nullif(length(regexp_replace(q, '[-~]', '', 'g')), 0) AS rna
    FROM (SELECT q, n, i, unnest([0, n - 1, n // 2]) AS k FROM r) WHERE i = k),
  m AS (SELECT avg(coalesce(dna, 0)) AS dna, avg(coalesce(rna, 0)) AS rna FROM p)
  SELECT CASE WHEN greatest(dna, rna) <= 0.5 THEN 'PROTEIN' WHEN dna > rna THEN 'DNA' ELSE 'RNA' END AS seqtype FROM m"""))  # fmt: skip
def _(s, d):
    return sq.sequence_type(view(s, d, "seqs").withColumnRenamed("doc_id", "ord"))


@query("AGG07_lengths", with_("seqs", "SELECT CAST(max(length(seq)) AS INT) AS max_seqlen, min(length(seq)) = max(length(seq)) AS is_unilen FROM seqs"))
def _(s, d):
    return sq.lengths(view(s, d, "seqs"))


@query("SRT01_by_length", with_("seqs", "SELECT doc_id, CAST(length(seq) AS INT) AS len FROM seqs ORDER BY len DESC, doc_id"))
def _(s, d):
    return view(s, d, "seqs").select("doc_id", F.length("seq").alias("len")).orderBy(F.desc("len"), "doc_id")


@query("SRT02_head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def _(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(25)


@query("WIN07_relabel", with_("seqs", "SELECT doc_id, label, printf('%04d', row_number() OVER (ORDER BY doc_id)) AS new_label FROM seqs"))
def _(s, d):
    return sq.relabel(view(s, d, "seqs").withColumnRenamed("doc_id", "ord")).select(F.col("ord").alias("doc_id"), "label", "new_label")


@query("WIN08_record_table", with_("seqs", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY label) AS idx, upper(seq) AS seq FROM seqs"))
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("label")
    return view(s, d, "seqs").select("doc_id", "source", F.row_number().over(w).cast("long").alias("idx"), F.upper("seq").alias("seq"))


@query("SET06_concatenate_files", with_("seqs", "SELECT doc_id, label FROM seqs WHERE source < 'src15' UNION ALL SELECT doc_id, label FROM seqs WHERE source >= 'src15'"))
def _(s, d):
    v = view(s, d, "seqs").select("doc_id", "label", "source")
    return v.filter("source < 'src15'").unionByName(v.filter("source >= 'src15'")).drop("source")


@query("SET07_concatenate_alignments", with_("msa", "SELECT label, seq || reverse(seq) || lower(seq) AS seq FROM msa"))
def _(s, d):
    v = view(s, d, "msa")
    return sq.concatenate([v, v.withColumn("seq", F.reverse("seq")), v.withColumn("seq", F.lower("seq"))])


@query("SNK01_fasta_text", with_("seqs", "SELECT doc_id AS ord, '>' || label || chr(10) || rtrim(regexp_replace(seq, '(.{120})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM seqs"))
def _(s, d):
    return sq.fasta_records(view(s, d, "seqs").withColumnRenamed("doc_id", "ord"))


@query("SNK02_phylip_text", with_("msa", "SELECT CAST(c AS INT) AS chunk, ord, CASE WHEN c = 0 THEN rpad(label, 11, ' ') ELSE '' END || substr(seq, CAST(c * 60 + 1 AS BIGINT), 60) AS value FROM msa, range(0, 2) r(c)"))
def _(s, d):
    return sq.phylip_blocks(view(s, d, "msa"))


# ---- profiles --------------------------------------------------------------------------------------------------------

NA = "ATCG-RYKMSWBDHVN"
_LONG = "long AS (SELECT ord, i - 1 AS col, upper(substr(seq, i, 1)) AS b FROM (SELECT ord, seq, unnest(range(1, length(seq) + 1)) AS i FROM msa))"
_PROF = f"""{_LONG}, sym AS (SELECT i AS k, substr('{NA}', i + 1, 1) AS symbol FROM range(0, 16) r(i)),
  cnt AS (SELECT col, symbol, k, 1e-10 + sum(CASE WHEN b = symbol THEN 1 ELSE 0 END) AS w FROM long, sym GROUP BY col, symbol, k),
  prof AS (SELECT CAST(col AS INT) AS col, symbol, k, w / sum(w) OVER (PARTITION BY col) AS weight FROM cnt)"""


@query("AGG08_profile", with_("msa", f"WITH {_PROF} SELECT col, symbol, round(weight, 6) AS weight FROM prof"))
def _(s, d):
    return profile.fit(view(s, d, "msa")).select("col", "symbol", F.round("weight", 6).alias("weight"))


@query("AGG09_consensus", with_("msa", f"""WITH {_PROF}, best AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY round(weight, 9) DESC, k) AS r FROM prof),
  th AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.99]::DOUBLE[]) AS threshold)
  SELECT threshold, string_agg(CASE WHEN weight < threshold THEN lower(symbol) ELSE symbol END, '' ORDER BY col) AS consensus FROM best, th WHERE r = 1 GROUP BY threshold"""))  # fmt: skip
def _(s, d):
    return profile.consensus(profile.fit(view(s, d, "msa")))


@query("AGG10_profile_likelihood", with_("msa", f"WITH {_PROF} SELECT ord, round(sum(ln(weight)), 6) AS loglk FROM long JOIN prof ON long.col = prof.col AND b = symbol GROUP BY ord"))
def _(s, d):
    v = view(s, d, "msa")
    return profile.likelihood(v, profile.fit(v))


_UNION = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in union_symbols().items()) + " WHEN '' THEN '-' ELSE 'N' END"


@query("ALN05_merge", with_("aligned", f"""WITH long AS (SELECT grp, i, substr(seq, i, 1) AS b FROM (SELECT grp, seq, unnest(range(1, length(seq) + 1)) AS i FROM aligned)),
  sets AS (SELECT grp, i, coalesce(string_agg(DISTINCT b, '' ORDER BY b) FILTER (WHERE b IN ('A', 'C', 'G', 'T')), '') AS k FROM long GROUP BY grp, i)
  SELECT grp, string_agg({_UNION}, '' ORDER BY i) AS seq FROM sets GROUP BY grp"""))  # fmt: skip
def _(s, d):
    v = view(s, d, "aligned").withColumn("seq", F.translate("seq", "NR", "--"))
    return profile.merge(v)
