"""URL filter: rules first, then gradient-boosted trees on what the URL looks like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import ascii_lower
from terrafold.session import cut_lineage

#: (rule, verdict): a host and all below it, and the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Bounds of what is fitted.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 42
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens",
    "longest_run", "suffix_rate", "suffix_seen", "head_rate", "head_seen",
)
#: Hosts are dealt into so many folds; a row's rates are those of the other folds' hosts.
FOLDS = 5
#: How many imagined labels, half of each kind, draw a rate towards one half.
PRIOR = 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (
        ascii_lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))),
        F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")),
    )


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one asked wins
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(s, "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` and what can be read off each URL; a null url counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    out = pages.select(*pages.columns, url.alias("_url"), host.alias("_host"), path.alias("_path"))
    labels = F.split("_host", r"\.")
    return out.select(
        "*",
        F.char_length("_url").cast("double").alias("length"),
        F.char_length("_host").cast("double").alias("host_length"),
        F.char_length("_path").cast("double").alias("path_length"),
        (F.char_length("_path") - F.char_length(F.replace("_path", F.lit("/")))).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        (F.char_length(F.regexp_replace("_url", "[^0-9]+", "")) / F.greatest(F.char_length("_url"), F.lit(1))).alias("digit_ratio"),
        _entropy(F.col("_url")).alias("entropy"),
        F.regexp_count("_url", F.lit(r"[?&][^=&#]*=")).cast("double").alias("parameters"),
        F.regexp_count("_url", F.lit("-")).cast("double").alias("hyphens"),
        F.array_max(F.transform(F.split("_host", r"[^a-z]+"), F.char_length)).cast("double").alias("longest_run"),
        F.substring_index("_host", ".", -1).alias("_suffix"),
        F.substring_index(F.ltrim("_path", F.lit("/")), "/", 1).alias("_head"),
        F.pmod(F.xxhash64("_host"), F.lit(FOLDS)).cast("int").alias("_fold"),
    )


#: What rates are kept of: the last label of the host, and the first part of the path.
RATED = ("_suffix", "_head")


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """(key, _fold, blocked, seen): labelled URLs of each value by fold of their hosts."""
    return labelled.groupBy(key, "_fold").agg(F.sum("label").alias("blocked"), F.count("*").cast("double").alias("seen"))


def _with_rates(df: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """Rate and number of labels of each row's suffix and head, from the labels of all hosts but those of its own fold.

    So neither the rows that train the trees nor those that they judge know their own host's labels.
    """
    for key, table in rates.items():
        whole = table.groupBy(key).agg(F.sum("blocked").alias("_b"), F.sum("seen").alias("_s"))
        own = table.select(key, "_fold", F.col("blocked").alias("_ob"), F.col("seen").alias("_os"))
        met = df.join(whole, key, "left").join(own, [key, "_fold"], "left").fillna(0.0, ["_b", "_s", "_ob", "_os"])
        seen = F.col("_s") - F.col("_os")
        rate = (F.col("_b") - F.col("_ob") + PRIOR / 2) / (seen + PRIOR)
        df = met.withColumns({f"{key[1:]}_rate": rate, f"{key[1:]}_seen": seen}).drop("_b", "_s", "_ob", "_os")
    return df


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS, held_out: int | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of each row of ``pages``.

    The URLs that a rule decides are the labelled ones. Suffixes and first parts of
    paths are counted over all of them, for each row without the hosts of its own fold. The trees are fitted on at most ``sample_rows``,
    drawn by the hash of URL and page_id, and judge the rest; ``p_block`` is their estimate for every URL. With ``held_out``,
    labels of that fold's hosts are used for nothing, so ``p_block`` can be measured against them. A null url, or one
    without ``://``, has no host and no path, so no rule fits it and the trees
    judge it. With labels of one kind only (or none) there is nothing to fit:
    the rest gets that kind (or ``allow``). An empty table gives an empty table.
    Repeated rows count, and come back, as often as they occur. A URL's cost is
    in proportion to its length.
    """
    rows = lexical(pages.select("page_id", "url")).withColumn("rule", rule_for(F.col("_host"), F.col("_path"), rules))
    told = {rule: verdict for rule, verdict in rules}
    verdict = F.lit(None).cast("string")
    for rule, v in told.items():
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    rows = rows.withColumn("told", verdict)

    numbers = [c for c in FEATURES if not c.endswith(("_rate", "_seen"))]
    labelled = rows.where("told IS NOT NULL") if held_out is None else rows.where((F.col("_fold") != held_out) & F.col("told").isNotNull())
    labelled = labelled.withColumn("label", (F.col("told") == "block").cast("double"))
    train = cut_lineage(
        labelled.select("label", *RATED, "_fold", *numbers, F.xxhash64("url", "page_id").alias("_order"))
        .orderBy("_order").limit(sample_rows).drop("_order")
    )
    kinds = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        known = "block" if 1.0 in kinds else "allow"
        scored = rows.withColumn("p_block", F.lit(1.0 if known == "block" else 0.0))
    else:
        rates = {key: cut_lineage(_rates(labelled, key)) for key in RATED}
        pack = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(
            pack.transform(_with_rates(train, rates)).select("label", "features")
        )
        found = fitted.transform(pack.transform(_with_rates(rows, rates)))
        scored = found.withColumn("p_block", F.get(vector_to_array("probability"), 1))
    return scored.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("told", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block",
    )
