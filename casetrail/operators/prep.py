"""Leakage-safe feature preparation: everything is fitted on the train rows and applied anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.functions import fixed
from casetrail.functions.clock import years_of_experience
from casetrail.functions.scalars import number
from casetrail.operators.ranks import grouped_quantiles, hashed_rank

UNKNOWN = "Unknown"


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _long(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """(column, value) rows of the given columns."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def column_types(df: DataFrame, exclude: Sequence[str] = (), limit: int = 6) -> DataFrame:
    """Kind per column: numeric unless whole-numbered with at most ``limit`` values; text is categorical."""
    numeric = [c for c in df.columns if c not in exclude and _is_numeric(df, c)]
    text = [c for c in df.columns if c not in exclude and not _is_numeric(df, c)]
    spark = df.sparkSession
    others = spark.createDataFrame([(c, "categorical") for c in text], "column string, kind string")
    if not numeric:
        return others
    values = _long(df, numeric).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("__1"))
    seen = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"),
                                        F.min((F.col("value") == F.floor("value")).cast("int")).alias("whole"))
    listed = spark.createDataFrame([(c,) for c in numeric], "column string")
    kinds = listed.join(seen, "column", "left").select("column", F.when(
        (F.col("whole") == 1) & (F.col("n") <= limit), "categorical").otherwise("continuous").alias("kind"))
    return kinds.unionByName(others)


@dataclass
class Prepared:
    """Fitted parameters; their size depends on columns and levels, not on rows."""
    continuous: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Output columns in order: continuous ones, then one per category level."""
        return self.continuous + [f"{c}_{v}" for c in self.categorical for v in self.levels[c]]


def iqr_bounds(train: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Clip limits q1 - k * iqr, q3 + k * iqr for all columns in one pass (one row per column comes back)."""
    rows = grouped_quantiles(_long(train, columns), ["column"], "value", {"q1": 0.25, "q3": 0.75}).collect()
    return {r["column"]: (r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"])) for r in rows}


def clip(c: Column, bounds: tuple[float, float] | None) -> Column:
    if bounds is None:
        return c
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(bounds[0])), F.lit(bounds[1])))


def iqr_clip(train: DataFrame, df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    bounds = iqr_bounds(train, columns, k)
    return df.withColumns({c: clip(F.col(f"`{c}`").cast("double"), bounds.get(c)) for c in columns})


def level_rows(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category levels as rows (column, value), for any number of levels."""
    return _long(train, columns, "string").select("column", F.coalesce("value", F.lit(UNKNOWN)).alias("value")).distinct()


def levels_of(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted category levels per column: fitted parameters, each of which becomes an output column.

    A column with more levels than a table can have columns belongs into ``sparse_one_hot``.
    """
    rows = level_rows(train, columns).collect()
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}


def fit_preprocess(train: DataFrame, exclude: Sequence[str] = (), clip_k: float | None = 1.5, standardise: bool = True,
                   types: Mapping[str, str] | None = None) -> Prepared:
    """Column kinds, clip limits, means after clipping, population scale and category levels from the train rows."""
    kinds = dict(types) if types else {r["column"]: r["kind"] for r in column_types(train, exclude).collect()}
    wanted = [c for c in train.columns if c not in exclude and c in kinds]
    state = Prepared([c for c in wanted if kinds[c] == "continuous"], [c for c in wanted if kinds[c] == "categorical"])
    if state.continuous:
        if clip_k is not None:
            state.bounds = iqr_bounds(train, state.continuous, clip_k)
        clipped = {c: clip(number(F.col(f"`{c}`")), state.bounds.get(c)) for c in state.continuous}
        row = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(clipped.values())]).first()
        state.means = {c: (0.0 if row[f"m{i}"] is None else float(row[f"m{i}"])) for i, c in enumerate(clipped)}
        if standardise:
            filled = {c: F.coalesce(v, F.lit(state.means[c])) for c, v in clipped.items()}
            row = train.agg(*[f(v).alias(f"{p}{i}") for i, v in enumerate(filled.values())
                              for p, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
            state.centre = {c: float(row[f"a{i}"]) for i, c in enumerate(filled)}
            # A constant column keeps its spread of 0 and is only centred.
            state.scale = {c: float(row[f"s{i}"]) or 1.0 for i, c in enumerate(filled)}
    if state.categorical:
        state.levels = levels_of(train, state.categorical)
    return state


def apply_preprocess(df: DataFrame, state: Prepared, keep: Sequence[str] = ()) -> DataFrame:
    """Fitted transform as one projection. Absent columns take the fill value; unseen levels give all zeros."""
    result = [F.col(f"`{c}`") for c in keep]
    for c in state.continuous:
        mean = F.lit(state.means.get(c, 0.0))
        value = F.coalesce(clip(number(F.col(f"`{c}`")), state.bounds.get(c)), mean) if c in df.columns else mean
        if c in state.scale:
            value = (value - F.lit(state.centre[c])) / F.lit(state.scale[c])
        result.append(value.alias(c))
    for c in state.categorical:
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN)) if c in df.columns else F.lit(UNKNOWN)
        result += [(value == F.lit(v)).cast("double").alias(f"{c}_{v}") for v in state.levels[c]]
    return df.select(*result)


def impute(train: DataFrame, df: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Train means for numbers, 'Unknown' for categories."""
    means = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(continuous)]).first() if continuous else None
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(means[f"m{i}"] or 0.0)))
              for i, c in enumerate(continuous)}
    return df.withColumns(filled | {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN)) for c in categorical})


def sparse_one_hot(train: DataFrame, df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One-hot encoding in long form, for any number of levels: (ids, feature) where the value is 1.

    Features are named as in ``one_hot``; values that the train rows do not have give no row.
    """
    values = df.select(*ids, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns]).unpivot(list(ids), list(columns), "column", "value")
    return values.join(level_rows(train, columns), ["column", "value"], "left_semi").select(*ids, F.concat_ws("_", "column", "value").alias("feature"))


def one_hot(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    state = Prepared([], [column], levels=levels_of(train, [column]))
    return apply_preprocess(df, state, keep=[c for c in df.columns if c != column])


def standardise(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation by the train rows."""
    row = train.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns)
                      for p, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"a{i}"])) / F.lit(float(row[f"s{i}"]) or 1.0)
                           for i, c in enumerate(columns)})


def mask(df: DataFrame, ids: Sequence[str], rates: Mapping[str, float] = fixed.MASKING_RATES, seed: int = 0) -> DataFrame:
    """Blank each listed column at its rate, by a repeatable draw per row and column."""
    changed = {}
    for c, rate in rates.items():
        if c in df.columns and rate > 0:
            digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(c), *[F.col(i).cast("string") for i in ids]))
            draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
            changed[c] = F.when(draw >= rate, F.col(f"`{c}`"))
    return df.withColumns(changed) if changed else df


def provider_features(providers: DataFrame, state: Prepared | None = None) -> tuple[DataFrame, Prepared]:
    """Prepared provider attributes without ids, names and free text; start dates become years of experience."""
    left_out = ("ProvName", "NPI", "PrimaryDeptID", "PrimaryDeptName", "ProvType", "ProvStartDate")
    table = providers
    if "ProvStartDate" in providers.columns:
        table = table.withColumn("YearsExperience", years_of_experience(F.col("ProvStartDate")))
    table = table.drop(*left_out)
    state = state or fit_preprocess(table, exclude=["ProvID"])
    return apply_preprocess(table, state, keep=["ProvID"]), state


def unit_features(units: DataFrame, state: Prepared | None = None) -> tuple[DataFrame, Prepared]:
    """Prepared unit attributes; only the ids are left out."""
    table = units.drop("LocationID")
    state = state or fit_preprocess(table, exclude=["DepartmentID"])
    return apply_preprocess(table, state, keep=["DepartmentID"]), state


def confounders(df: DataFrame, train: DataFrame, ids: Sequence[str], age: str = "AgeYears", sex: str = "Gender") -> DataFrame:
    """Age filled with the train median and standardised on train, sex one-hot with the train levels."""
    middle = grouped_quantiles(train.select(number(F.col(age)).alias("a")), [], "a", {"m": 0.5}).first()["m"]

    def filled(frame: DataFrame) -> DataFrame:
        return frame.withColumn("__age", F.coalesce(number(F.col(age)), F.lit(middle)))

    row = filled(train).agg(F.avg("__age").alias("a"), F.stddev_pop("__age").alias("s")).first()
    levels = levels_of(train.select(sex), [sex])[sex]
    return filled(df).select(*ids, ((F.col("__age") - row["a"]) / (row["s"] + 1e-8)).alias("age_z"), *[
        F.coalesce((F.col(sex) == v), F.lit(v == UNKNOWN)).cast("double").alias(f"{sex}_{v}") for v in levels])


def perturb(df: DataFrame, columns: Sequence[str], mode: str, train: DataFrame | None = None, ids: Sequence[str] = (),
            seed: int = 42) -> DataFrame:
    """Damage a feature block: ``median`` / ``mean`` / ``zero`` replace it by train values, ``shuffle`` deals its rows
    to other rows (one permutation for the block), ``keep_only`` sets every other numeric column to its train median.
    """
    columns = list(columns)
    if mode == "keep_only":
        others = [c for c in df.columns if c not in columns and c not in ids and _is_numeric(df, c)]
        return perturb(df, others, "median", train, ids, seed)
    if not columns:
        return df
    if mode == "shuffle":
        target = hashed_rank(df, [], ids, f"{seed}:to", "__r")
        source = hashed_rank(df, [], ids, f"{seed}:from", "__r").select("__r", *[
            F.col(f"`{c}`").alias(f"__s_{c}") for c in columns])
        moved = target.join(source, "__r")
        return moved.select(*[F.col(f"`__s_{c}`").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
    if mode == "zero":
        fill = {c: 0.0 for c in columns}
    elif mode == "mean":
        row = train.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
        fill = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    elif mode == "median":
        rows = grouped_quantiles(_long(train, columns), ["column"], "value", {"m": 0.5}).collect()
        fill = {r["column"]: r["m"] for r in rows}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumns({c: F.lit(fill.get(c)).cast("double") for c in columns})


# Named damage scenarios: (name, mode, block); blocks are the caller's column groups.
SCENARIOS = (
    ("baseline_clean", "none", None),
    ("missing_charlson", "zero", "charlson"),
    ("missing_utilization", "median", "utilization"),
    ("missing_geocode_sdoh", "median", "geocode"),
    ("missing_cpt", "zero", "cpt"),
    ("missing_dispo", "zero", "dispo"),
    ("missing_order_sequence", "zero", "sequence"),
    ("missing_provider_roles", "zero", "role"),
    ("missing_seq_scalars", "median", "seq_scalars"),
    ("wrong_demographics", "shuffle", "demographics"),
    ("wrong_sdoh", "shuffle", "geocode"),
    ("wrong_cpt", "shuffle", "cpt"),
    ("wrong_order_sequence", "shuffle", "sequence"),
    ("wrong_provider_roles", "shuffle", "role"),
    ("wrong_charlson", "shuffle", "charlson"),
    ("wrong_utilization", "shuffle", "utilization"),
    ("bare_bones_demog_only", "keep_only", "demographics+geocode"),
)


def scenario(df: DataFrame, name: str, blocks: Mapping[str, Sequence[str]], train: DataFrame, ids: Sequence[str],
             seed: int = 42) -> DataFrame:
    """The frame under one named damage scenario; blocks without columns leave it as it is."""
    found = {n: (mode, block) for n, mode, block in SCENARIOS}
    mode, block = found[name]
    columns = [c for b in (block or "").split("+") for c in blocks.get(b, ())]
    if mode == "none" or not columns:
        return df
    return perturb(df, columns, mode, train, ids, seed)


def scenarios(df: DataFrame, blocks: Mapping[str, Sequence[str]], train: DataFrame, ids: Sequence[str], seed: int = 42,
              named: Sequence[tuple[str, str, str | None]] = SCENARIOS) -> DataFrame:
    """All rows under every named damage scenario, told apart by the column ``scenario``.

    One pass: rows are dealt once by a rank join, whose shuffled columns serve all scenarios (each shuffle is the same
    permutation of its block); train medians and means of all columns come from one pass each; rows are then repeated
    per scenario and each block column picks its value. ``keep_only`` sets the columns of all other blocks to their
    medians. Block columns become doubles; scenarios whose blocks have no columns repeat the frame as it is.
    """
    every = list(dict.fromkeys(c for columns in blocks.values() for c in columns))
    damage: dict[str, dict[str, list[str]]] = {c: {} for c in every}
    for name, mode, block in named:
        columns = [c for b in (block or "").split("+") for c in blocks.get(b, ())]
        if mode == "keep_only" and columns:
            mode, columns = "median", [c for c in every if c not in columns]
        for c in columns:
            damage[c].setdefault(mode, []).append(name)
    used = {mode for found in damage.values() for mode in found}
    if unknown := used - {"none", "zero", "median", "mean", "shuffle"}:
        raise ValueError(f"unknown modes {sorted(unknown)}")
    fill: dict[tuple[str, str], float] = {}
    if "median" in used:
        fill |= {("median", r["column"]): r["m"] for r in grouped_quantiles(_long(train, every), ["column"], "value", {"m": 0.5}).collect()}
    if "mean" in used:
        row = train.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(every)]).first()
        fill |= {("mean", c): row[f"m{i}"] for i, c in enumerate(every)}
    moved = [c for c in every if "shuffle" in damage[c]]
    rows = df
    if moved:
        target = hashed_rank(df, [], ids, f"{seed}:to", "__r")
        source = hashed_rank(df, [], ids, f"{seed}:from", "__r").select("__r", *[F.col(f"`{c}`").alias(f"__s_{c}") for c in moved])
        rows = target.join(source, "__r").drop("__r")
    rows = rows.withColumn("scenario", F.explode(F.array(*[F.lit(name) for name, _, _ in named])))

    def value(c: str) -> Column:
        out = F.col(f"`{c}`").cast("double")
        for mode, names in damage[c].items():
            if mode != "none":
                new = F.lit(0.0) if mode == "zero" else F.col(f"`__s_{c}`").cast("double") if mode == "shuffle" else F.lit(fill.get((mode, c))).cast("double")
                out = F.when(F.col("scenario").isin(names), new).otherwise(out)
        return out.alias(c)

    return rows.select("scenario", *[value(c) if c in every else F.col(f"`{c}`") for c in df.columns])
