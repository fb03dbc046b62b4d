"""Endmember libraries, synthetic mixtures, soil groups and network scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.hashing import key_digest, unit_hash
from terrafold.operators.sampling import shuffled_index
from terrafold.session import cut_lineage

SHADE = 0.01  # fixed value: reflectance of the shade endmember in every band
CLASSES = ["NPV", "PV", "Soil", "Shade"]
MAX_PARAMETERS = 20_000_000


def endmember_library(parts: dict[int, DataFrame], names: dict[str, str]) -> DataFrame:
    """Stack class tables under common band names with a class column."""
    out = None
    for cls, df in parts.items():
        have = {c: names.get(c, c) for c in df.columns}
        p = df.select(*[F.col(c).alias(n) for c, n in have.items()], F.lit(cls).alias("cls"))
        out = p if out is None else out.unionByName(p)
    return out


def mix_spectra(
    library: DataFrame, draws: DataFrame, key: list[str], bands: list[str], seed: int = 0, replace: bool = False, shade: float = SHADE
) -> DataFrame:
    """Linear mixtures of 2 or 3 endmembers, one per row of ``draws``.

    Classes come with or without replacement, one spectrum per chosen class,
    shade joins with probability one half, and uniform weights are scaled to
    sum to 1. All draws are hashes of the row key, and spectra are fetched by
    an equi-join on (class, position in the shuffled class).
    """
    k = [F.col(c) for c in key]
    u = lambda tag: unit_hash(*k, F.lit(tag), seed=seed)
    lib = shuffled_index(library, ["cls"], ["id"], seed, "idx").select("cls", "idx", *bands)
    size = library.agg(F.array(*[F.count_if(F.col("cls") == c) for c in range(3)])).scalar()
    n = F.when(u("n") < 0.5, 2).otherwise(3)
    if replace:
        classes = F.array(*[F.floor(u(f"c{j}") * 3).cast("int") for j in range(3)])
    else:
        order = F.array_sort(F.array(*[F.struct(u(f"c{c}").alias("u"), F.lit(c).alias("c")) for c in range(3)]))
        classes = F.transform(order, lambda s: s["c"])
    d = draws.select(*key).withColumns({"_size": size, "_c": classes, "_k": n})
    part = lambda j: F.struct(
        F.col("_c")[j].alias("cls"), F.floor(u(f"i{j}") * F.col("_size")[F.col("_c")[j]]).cast("long").alias("idx"), u(f"w{j}").alias("w")
    )
    shaded = F.struct(F.lit(3).alias("cls"), F.lit(0).cast("long").alias("idx"), u("ws").alias("w"))
    parts = F.slice(F.array(*[part(j) for j in range(3)]), 1, F.col("_k"))
    parts = F.when(u("shade") < 0.5, F.array_append(parts, shaded)).otherwise(parts)
    d = d.select(*key, parts.alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, s: a + s["w"])
    rows = d.withColumn("_t", total).select(*key, "_t", F.explode("_p").alias("_s"))
    rows = rows.select(*key, F.col("_s.cls").alias("cls"), F.col("_s.idx").alias("idx"), (F.col("_s.w") / F.col("_t")).alias("f"))
    # shade has no spectrum to fetch: half of all mixtures would meet under its one key
    own = rows.where(F.col("cls") != 3).join(lib, ["cls", "idx"], "left")
    j = own.unionByName(rows.where(F.col("cls") == 3), allowMissingColumns=True)
    value = lambda b: F.col("f") * F.when(F.col("cls") == 3, F.lit(shade)).otherwise(F.col(b))
    label = lambda c: F.sum(F.when(F.col("cls") == c, F.col("f")).otherwise(0.0))
    return j.groupBy(*key).agg(
        *[F.sum(value(b)).alias(b) for b in bands], *[label(i).alias(n) for i, n in enumerate(CLASSES)]
    )


def pure_spectra(library: DataFrame, bands: list[str]) -> DataFrame:
    """Every endmember as a mixture of itself."""
    return library.select(
        F.col("id").alias("mix_id"), *bands, *[(F.col("cls") == i).cast("double").alias(n) for i, n in enumerate(CLASSES)]
    )


def single_label(mixtures: DataFrame, cls: int) -> DataFrame:
    """The fraction of one class as the only label."""
    return mixtures.withColumn("fraction", F.col(CLASSES[cls])).drop(*CLASSES)


# --- soil groups -------------------------------------------------------------


def assign_group(
    df: DataFrame, bands: list[str], centres: list[list[float]], labels: list[int], valid: Column, none: int = -10000
) -> DataFrame:
    """Label of the nearest centre; ``none`` where not valid or a band is missing."""
    ok = valid
    for b in bands:
        ok = ok & F.col(b).isNotNull()
    d2 = lambda c: sum(((F.col(b) - F.lit(float(v))) ** 2 for b, v in zip(bands, c)), F.lit(0.0))
    best = F.array_min(F.array(*[F.struct(d2(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    names = F.array(*[F.lit(int(v)) for v in labels])
    return df.withColumn("soil_group", F.when(F.coalesce(ok, F.lit(False)), names[best["i"]]).otherwise(F.lit(none)))


Centres = dict[int, list[list[float]]]


def _nearest(x: str, centres: list[list[float]]) -> Column:
    """(d, i): squared distance to the nearest centre and its number, the smaller on ties."""
    d2 = lambda c: F.aggregate(F.zip_with(F.col(x), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    told = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("c"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(F.transform(told, lambda m: F.struct(d2(m["c"]).alias("d"), m["i"].alias("i"))))


def _assigned(x: DataFrame, centres: Centres) -> DataFrame:
    """(k, d, i, _x): each row once for each number of groups."""
    every = F.array(*[F.struct(F.lit(k).alias("k"), _nearest("_x", c).alias("n")) for k, c in centres.items()])
    return x.select("_x", F.explode(every).alias("_a")).select("_a.k", "_a.n.d", "_a.n.i", "_x")


def fit_soil_groups(
    df: DataFrame, bands: list[str], ks: list[int], key: str = "id", rounds: int = 8, seed: int = 42
) -> DataFrame:
    """Silhouette and within-group sum of squares for each number of groups.

    K-means on min-max scaled bands, rows with a missing band left out. All
    numbers of groups are fitted together: a round is one pass that assigns
    every row for every k and sums the groups. Centres, and what the silhouette
    needs of a group, are all that returns to the driver: a few numbers a band and
    group. Groups start at the first rows by a hash of ``key``, so a rerun and
    SQL find the same; a group without rows keeps its centre. The silhouette is
    that of squared distances, from sums of each group; rows alone in a group
    have 0.
    """
    full = df.dropna(subset=bands).select(key, *[F.col(b).cast("double").alias(b) for b in bands])
    edge = full.agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = {b: (edge[f"lo_{b}"], edge[f"hi_{b}"]) for b in bands}
    unit = [(F.col(b) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.5) for b, (lo, hi) in spans.items()]
    x = cut_lineage(full.select(key, F.array(*unit).alias("_x")))
    first = [r["_x"] for r in x.orderBy(key_digest(F.col(key), seed=seed), key).limit(max(ks)).collect()]
    centres: Centres = {k: first[:k] for k in ks} if first else {}
    mean = [F.avg(F.get("_x", F.lit(j))).alias(f"_{j}") for j in range(len(bands))]
    for _ in range(rounds if first else 0):
        rows = _assigned(x, centres).groupBy("k", "i").agg(*mean).collect()
        moved = {(r["k"], r["i"]): [r[f"_{j}"] for j in range(len(bands))] for r in rows}
        new = {k: [moved.get((k, i), c) for i, c in enumerate(all_)] for k, all_ in centres.items()}
        if new == centres:
            break
        centres = new
    schema = "k int, silhouette double, within_ss double"
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    total = [F.sum(F.get("_x", F.lit(j))).alias(f"_{j}") for j in range(len(bands))]
    norm = F.aggregate("_x", F.lit(0.0), lambda t, v: t + v * v)
    groups = _assigned(x, centres).groupBy("k", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"), *total).collect()
    sums: dict[int, list] = {}
    for g in sorted(groups, key=lambda g: (g["k"], g["i"])):
        sums.setdefault(g["k"], []).append(g)

    def far(k: int) -> Column:
        """For each group of k: its number, size, and mean squared distance to the row (of the others, for its own)."""
        told = F.array(*[
            F.struct(F.lit(g["i"]).alias("i"), F.lit(float(g["n"])).alias("n"), F.lit(g["q"]).alias("q"), F.array(*[F.lit(g[f"_{j}"]) for j in range(len(bands))]).alias("s"))
            for g in sums[k]
        ])
        dot = lambda s: F.aggregate(F.zip_with(F.col("_x"), s, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        sum_d2 = lambda g: g["n"] * norm + g["q"] - 2 * dot(g["s"])
        own = F.get(F.filter(told, lambda g: g["i"] == F.col("i")), F.lit(0))
        others = F.array_min(F.transform(F.filter(told, lambda g: g["i"] != F.col("i")), lambda g: sum_d2(g) / g["n"]))
        a = sum_d2(own) / (own["n"] - 1)
        wide = F.greatest(a, others)
        return F.when(own["n"] > 1, F.when(wide > 0, (others - a) / wide).otherwise(0.0)).otherwise(0.0)

    width = F.lit(None).cast("double")
    for k in sums:
        width = F.when(F.col("k") == k, far(k)).otherwise(width)
    return _assigned(x, centres).groupBy(F.col("k").cast("int").alias("k")).agg(F.avg(width).alias("silhouette"), F.sum("d").alias("within_ss"))


# --- network ensembles -------------------------------------------------------

Networks = dict[tuple[int, str], list[list[tuple[np.ndarray, np.ndarray]]]]


def load_networks(weights: DataFrame) -> Networks:
    """Parameter table to arrays, after checking that it is small enough to ship.

    Columns: soil_group, class, iteration, layer, w array<array<double>>, b array<double>.
    """
    size = weights.agg(
        F.sum(F.size("b") + F.aggregate("w", F.lit(0), lambda a, r: a + F.size(r)))
    ).first()[0] or 0
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} parameters exceed the limit of {MAX_PARAMETERS} for shipping a model to tasks")
    nets: Networks = {}
    rows = sorted(weights.collect(), key=lambda r: (r["soil_group"], r["class"], r["iteration"], r["layer"]))
    last = None
    for r in rows:
        key = (r["soil_group"], r["class"])
        if (key, r["iteration"]) != last:
            nets.setdefault(key, []).append([])
            last = (key, r["iteration"])
        nets[key][-1].append((np.array(r["w"], float), np.array(r["b"], float)))
    return nets


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x[:, 0]


def ensemble_predict(
    df: DataFrame, bands: list[str], nets: Networks, group: str | None = None, classes: tuple[str, ...] = ("PV", "NPV", "Soil")
) -> DataFrame:
    """Mean of the ensemble per class: the global models (group 0) or each row's group; see ``ensemble_predict_sets``."""
    return ensemble_predict_sets(df, bands, nets, {"": group}, classes)


def ensemble_predict_sets(
    df: DataFrame, bands: list[str], nets: Networks, groups: dict[str, str | None], classes: tuple[str, ...] = ("PV", "NPV", "Soil")
) -> DataFrame:
    """Mean of the ensemble per class for several sets of models, side by side, from one pass over the rows.

    ``groups`` has, for the suffix of each set's columns, the column that tells a
    row's group, or None for the global models (group 0). Rows with a missing
    band, or of a group without models, get nulls. Models travel as one
    broadcast variable of checked size and score whole Arrow batches.
    """
    shipped = df.sparkSession.sparkContext.broadcast(nets)
    names = [f"{c}{suffix}" for suffix in groups for c in classes]

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def score(x: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        m = x.to_numpy(float)
        ok = ~np.isnan(m).any(1)
        out = np.full((len(m), len(names)), np.nan)
        for i in range(len(groups)):
            gv = pd.to_numeric(g.iloc[:, i]).to_numpy(float)
            for k in np.unique(gv[ok & ~np.isnan(gv)]):
                rows = ok & (gv == k)
                for j, c in enumerate(classes):
                    if models := shipped.value.get((int(k), c)):
                        out[rows, i * len(classes) + j] = np.mean([forward(m[rows], n) for n in models], axis=0)
        return pd.DataFrame(out, columns=names)

    of = [(F.lit(0) if g is None else F.col(g)).cast("double").alias(f"g{i}") for i, g in enumerate(groups.values())]
    s = df.withColumn("_s", score(F.struct(*[F.col(b).cast("double") for b in bands]), F.struct(*of)))
    return s.withColumns({c: F.nanvl(F.col(f"_s.{c}"), F.lit(None).cast("double")) for c in names}).drop("_s")
