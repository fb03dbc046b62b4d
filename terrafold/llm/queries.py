"""The registered queries of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from terrafold.llm import bpe, exact, fim, hyperminhash, lines, merkle, packing, pii, simhash, sketch, substrings, toxicity, urls
from terrafold.llm.common import body, shown_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketch.with_edited(table(spark, sf_dir, "documents"))
    return out.select(
        shown_id(F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@register
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select(
        shown_id(F.col("id")).alias("doc_id"), "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "tier", "step_group",
    )


@register
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    out = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select(
        shown_id(F.col("id")).alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@register
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op4_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), k AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, l.pos, l.line, k.first IS NOT NULL AND l.doc_id > k.first AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (toxicity.fold() == 0).alias("held_out"), toxicity.score(model, body()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans; ``n_added`` counts the spans that the method adds."""
    out = table(spark, sf_dir, "documents").select("doc_id", pii.pii_spans(body()).alias("s"))
    base = F.filter("s", lambda x: x["base"])

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return out.select(
        "doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("s")).alias("spans"),
        (F.size("s") - F.size(base)).cast("long").alias("n_added"),
    )


@register
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@register
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        shown_id(F.col("id")).alias("doc_id"),
        simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
        shown_id(F.col("component")).alias("component_id"),
    )


@register
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeat_dedup(table(spark, sf_dir, "documents"))
    return out.select(shown_id(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL["op10_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 9, upper: int = 4) -> str:
    """Trees of up to 8^levels documents a lang and 8^upper langs, one step of SQL a level."""

    def level(t: str, i: int, by: str) -> str:
        run = f"PARTITION BY {by}r // 8 ORDER BY r ROWS BETWEEN"
        group = f"{by}r // 8, n"
        return f"""
{t}s{i} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {t}{i}),
{t}{i + 1} AS (SELECT {by}r // 8 AS r, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h, (n + 7) // 8 AS n
  FROM {t}{i} GROUP BY {group}),"""

    def climb(t: str, i: int, by: str, rank: str) -> str:
        """From p to the level above: siblings are added and the hash is folded."""
        on = f"s.r = p.{rank} // {8**i}" + (" AND s.lang IS NOT DISTINCT FROM p.lang" if by else "")
        return f"""
{t}p{i + 1} AS (SELECT p.* REPLACE (p.sib || CASE WHEN s.n > 1 THEN s.lft || s.rgt ELSE '' END AS sib,
  CASE WHEN s.n > 1 THEN sha256(s.lft || p.f || s.rgt) ELSE p.f END AS f) FROM {t}p{i} p JOIN {t}s{i} s ON {on}),"""

    def leaf(text: str) -> str:
        told = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
        return f"sha256({' || '.join(told)} || coalesce(strlen({text}) || ':' || {text}, '-'))"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _CRC_SQL.format(x="doc_id::VARCHAR")
    return f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} END AS changed FROM documents, crc_table),
a0 AS (SELECT lang, doc_id, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d),
{"".join(level("a", i, "lang, ") for i in range(levels))}
b0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, h, count(*) OVER () AS n FROM a{levels}),
{"".join(level("b", i, "") for i in range(upper))}
ap0 AS (SELECT doc_id, lang, r, h AS leaf, coalesce(changed, h) AS f, '' AS sib FROM a0),
{"".join(climb("a", i, "lang", "r") for i in range(levels))}
bp0 AS (SELECT p.doc_id, p.leaf, b.h AS subroot, b.r, p.f, p.sib FROM ap{levels} p JOIN b0 b ON b.lang IS NOT DISTINCT FROM p.lang),
{"".join(climb("b", i, "", "r") for i in range(upper))}
root AS (SELECT h AS root FROM b{upper})
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM bp{upper}, root
"""


#: CRC-32 byte by byte, from its table of 256 remainders.
_CRC_TABLE_SQL = """crc_bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""
_CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295)"
)
ORACLE_SQL["op11_merkle_manifest"] = _merkle_sql()


@register
def op12_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hyperminhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        shown_id(F.col("id")).alias("doc_id"), "n_shingles", shown_id(F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


ORACLE_SQL["op12_hyperminhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
           range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM w
), n AS (
  SELECT s, min(doc_id) AS node, len(s) AS c FROM s WHERE len(s) > 0 GROUP BY s
), u AS (
  SELECT node, c, unnest(s) AS x FROM n
), link AS (
  SELECT a.node AS p, b.node AS q FROM u a JOIN u b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.c, b.c HAVING 100 * count(*) >= 85 * (a.c + b.c - count(*))
), edge AS (
  SELECT p, q FROM link UNION ALL SELECT q, p FROM link
), reach AS (
  SELECT node, node AS root FROM n UNION SELECT e.q, r.root FROM reach r JOIN edge e ON e.p = r.node AND r.root < e.q
), top AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(top.root, s.doc_id) AS component_id, coalesce(top.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN n ON n.s = s.s LEFT JOIN top ON top.node = n.node
"""


@register
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.rearranged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || doc_id) AS h
  FROM documents
), d AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS x FROM t
), c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
              WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
