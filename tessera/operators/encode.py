"""Categorical encoding (ENC1-ENC11).

Fitting collects per-column category statistics with one aggregation per
column group. While a column has at most ``MAP_LIMIT`` categories its codes
live in the fitted state: up to ``LITERAL_LIMIT`` of them as a literal map
(whole-stage codegen), more as a broadcast table of at most ``MAP_LIMIT``
rows. Above that, codes stay distributed: a code table computed with a
distributed global rank and joined on the value (shuffle join; AQE splits hot
values). A saved model takes its code tables along.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import dtype_name, is_numeric_type, string_columns
from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.plans.ranks import global_row_number
from tessera.plans.stats import _chunks, _exploded_counts, aggregate, distinct_counts, stats_input

MAP_LIMIT = 10_000      # categories kept in the fitted state
LITERAL_LIMIT = 256     # of them in a literal map, which is scanned row by row
ONEHOT_LIMIT = 1_000    # most one-hot columns; above, one sparse vector column
CLASS_LIMIT = 1_000_000  # class labels a model keeps as a list
NULL_TEXT = "None"      # pandas astype(str) of a missing object value

# Hint words that mark a text column as ordinal (ENC1).
ORDINAL_HINT_WORDS = [
    "low", "medium", "high", "very low", "very high",
    "small", "large", "poor", "fair", "good", "excellent",
    "never", "rarely", "sometimes", "often", "always",
    "none", "some", "most", "all",
    "grade", "level", "rank", "tier", "class",
]


def as_text(c: str) -> Column:
    """Category text as the reference sees it after ``astype(str)``."""
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))


# ------------------------------------------------------------------ advice
def _advice(n_unique: int, has_hint: bool, rule: str) -> str:
    if n_unique == 2:
        return "label"
    if rule == "analysis" and has_hint:
        return "ordinal"
    if n_unique <= 10:
        return "onehot"
    if n_unique <= 50:
        return "ordinal"
    return "frequency"


def _smallest(df: DataFrame, cols: list, n: int) -> dict:
    """Up to ``n`` smallest values per column, in order, as the text Python
    gives them; the columns' top-n selections run as one job."""
    parts = []
    for i, c in enumerate(cols):
        top = df.select(F.col(c).alias("v")).where("v is not null").distinct().orderBy("v").limit(n)
        entry = F.struct(*[(F.col("v") if k == i else F.lit(None).cast(df.schema[d].dataType)).alias(f"v{k}")
                           for k, d in enumerate(cols)])
        parts.append(top.select(F.lit(i).alias("i"), entry.alias("s")))
    out: dict = {c: [] for c in cols}
    for part in _chunks(list(range(len(cols)))):
        for r in reduce(DataFrame.unionByName, [parts[i] for i in part]).collect():
            out[cols[r["i"]]].append(r["s"][r["i"]])
    return {c: [str(v) for v in sorted(vs)] for c, vs in out.items()}


def encoding_advice_rows(df: DataFrame, target: str, rule: str = "analysis",
                         samples: int = 5) -> list[dict]:
    """ENC1/ENC2/ENC10 statistics: distinct counts (one exploded pass), hint
    words (one ``bool_or`` pass) and up to ``samples`` smallest values per
    text column (a top-k per column, bounded)."""
    cols = list(df.columns)
    nun = distinct_counts(df, cols)
    text = [c for c in cols if c != target and not is_numeric_type(df.schema[c].dataType)]
    hints = aggregate(df, {c: F.bool_or(F.lower(F.trim(F.col(c).cast("string"))).isin(ORDINAL_HINT_WORDS))
                           for c in text}) if text else {}
    shown = _smallest(df, cols, samples) if samples else {}
    rows = []
    for c in cols:
        dt = df.schema[c].dataType
        is_target = c == target
        numeric = is_numeric_type(dt)
        if is_target or numeric:
            rec, needs = "none", False
        else:
            rec, needs = _advice(nun[c], bool(hints.get(c)), rule), True
        sample = ", ".join(shown[c]) if samples else None
        rows.append({"column_name": c, "dtype": dtype_name(dt), "n_unique": nun[c],
                     "is_target": is_target, "needs_encoding": needs, "recommended": rec,
                     "sample_values": sample})
    rows.sort(key=lambda r: (not r["is_target"], not r["needs_encoding"]))
    return rows


ADVICE_SCHEMA = ("column_name string, dtype string, n_unique long, is_target boolean, "
                 "needs_encoding boolean, recommended string, sample_values string")


def encoding_profile_column(df: DataFrame, col: str, target: str) -> DataFrame:
    """ENC1 for one column."""
    rows = encoding_advice_rows(df.select(*{col, target} & set(df.columns)), target)
    rows = [r for r in rows if r["column_name"] == col]
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], ADVICE_SCHEMA)


def encoding_profile(df: DataFrame, target: str) -> DataFrame:
    """ENC2: advice for every column, target first, then text columns."""
    rows = encoding_advice_rows(df, target)
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], ADVICE_SCHEMA)


def recommend_encoding(df: DataFrame, target: str, rule: str = "pipeline") -> dict[str, str]:
    """ENC10 (``pipeline``: no hint-word rule) or ENC1 (``analysis``) for the
    text feature columns."""
    text = [c for c in string_columns(df) if c != target]
    # thresholds stop at 50: exact below, HyperLogLog (certainly > 50) above,
    # so free-text columns never go through an exact-distinct shuffle
    nun = distinct_counts(df, text, cap=50)
    hints = aggregate(df, {c: F.bool_or(F.lower(F.trim(F.col(c))).isin(ORDINAL_HINT_WORDS))
                           for c in text}) if (text and rule == "analysis") else {}
    return {c: _advice(nun[c], bool(hints.get(c)), rule) for c in text}


# ------------------------------------------------------------ fitting state
def _sorted_categories(df: DataFrame, c: str, null_as_text: bool) -> list | None:
    """Sorted category texts, or None when there are more than MAP_LIMIT."""
    x = as_text(c) if null_as_text else F.col(c).cast("string")
    est = aggregate(df, {"d": F.approx_count_distinct(x)})["d"]
    if est > 2 * MAP_LIMIT:          # certainly too many: keep the codes distributed
        return None
    d = df.select(x.alias("v")).where(F.col("v").isNotNull()).distinct()
    head = d.limit(MAP_LIMIT + 1).collect()
    if len(head) > MAP_LIMIT:
        return None
    return sorted(r["v"] for r in head)


def _literal_map(mapping: dict, value_type: str) -> Column:
    if not mapping:
        return F.create_map().cast(f"map<string,{value_type}>")
    keys = F.array(*[F.lit(k) for k in mapping])
    vals = F.array(*[F.lit(v).cast(value_type) for v in mapping.values()])
    return F.map_from_arrays(keys, vals)


def _fit_column(df: DataFrame, c: str, method: str, order_key: str | None, workdir: str | None) -> dict:
    if method in ("ordinal", "label"):
        cats = _sorted_categories(df, c, null_as_text=True)
        if cats is None:
            return _fit_ordinal_table(df, c, workdir)
        return {"method": "ordinal", "categories": cats}
    if method == "onehot":
        cats = _sorted_categories(df, c, null_as_text=True)
        if cats is None or len(cats) - 1 > ONEHOT_LIMIT:
            state = _fit_ordinal_table(df, c, workdir)
            size = df.sparkSession.read.parquet(state["table"]).count()
            return {"method": "onehot_vector", "table": state["table"], "size": size, "name": f"{c}_onehot"}
        return {"method": "onehot", "categories": cats,
                "names": [f"{c}_{v}" for v in cats[1:]]}
    if method == "frequency":
        counts = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v"))
                    .agg(F.count(F.lit(1)).alias("n")))
        head = counts.limit(MAP_LIMIT + 1).collect()
        if len(head) > MAP_LIMIT:
            total = df.where(F.col(c).isNotNull()).count()
            return {"method": "frequency", "table": _save(counts.select(
                "v", (F.col("n") / F.lit(total)).alias("code")), workdir, c)}
        total = sum(r["n"] for r in head)
        return {"method": "frequency", "freq": {r["v"]: r["n"] / total for r in head}}
    if method == "binary":
        firsts = (df.where(F.col(c).isNotNull())
                    .groupBy(F.col(c).cast("string").alias("v"))
                    .agg((F.min(F.col(order_key)) if order_key else F.lit(0)).alias("first")))
        head = firsts.limit(MAP_LIMIT + 1).collect()
        if len(head) > MAP_LIMIT:
            ranked = global_row_number(firsts, ["first", "v"], out="code").select("v", "code")
            table = _save(ranked, workdir, c)
            return {"method": "binary", "table": table, **_bits(c, df.sparkSession.read.parquet(table).count())}
        head.sort(key=lambda r: (r["first"], r["v"]))
        return {"method": "binary", "codes": {r["v"]: i for i, r in enumerate(head)}, **_bits(c, len(head))}
    raise ValueError(f"unknown encoding {method!r}")


def _bits(c: str, categories: int) -> dict:
    n = max(1, int(math.ceil(math.log2(categories + 1))))
    return {"n_bits": n, "names": [f"{c}_bit{b}" for b in range(n)]}


def _fit_batched(df: DataFrame, methods: dict) -> dict:
    """Code maps for many text columns at once: one distinct-estimate pass,
    then value counts per column (chunked union jobs, map-side combined).
    Columns above MAP_LIMIT categories are left to the per-column path."""
    if not methods:
        return {}
    keyed = {c: (as_text(c) if m != "frequency" else F.col(c).cast("string")) for c, m in methods.items()}
    est = aggregate(df, {c: F.approx_count_distinct(x) for c, x in keyed.items()})
    small = [c for c in methods if est[c] <= 2 * MAP_LIMIT]
    if not small:
        return {}
    proj = df.select(*[keyed[c].alias(c) for c in small])
    values: dict = {c: [] for c in small}
    for part in _chunks(small):
        for r in _exploded_counts(proj, part).collect():
            values[part[r["i"]]].append((r["sv"], r["cnt"]))
    state = {}
    for c in small:
        vals = values[c]
        if len(vals) > MAP_LIMIT:
            continue
        m = methods[c]
        cats = sorted(v for v, _ in vals)
        if m in ("ordinal", "label"):
            state[c] = {"method": "ordinal", "categories": cats}
        elif m == "onehot":
            if len(cats) - 1 > ONEHOT_LIMIT:
                continue                 # one sparse vector column instead
            state[c] = {"method": "onehot", "categories": cats, "names": [f"{c}_{v}" for v in cats[1:]]}
        else:
            total = sum(n for _, n in vals)
            state[c] = {"method": "frequency", "freq": {v: n / total for v, n in vals}}
    return state


def _save(df: DataFrame, workdir: str | None, c: str) -> str:
    from tessera.session import ensure_checkpoint_dir
    import uuid
    base = workdir or ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/codes-{c}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return path


def _code_table(values: DataFrame, c: str, workdir: str | None) -> str:
    """Path of a table (v, code): the distinct values in sorted order."""
    return _save(global_row_number(values.distinct(), ["v"], out="code"), workdir, c)


def _fit_ordinal_table(df, c, workdir):
    return {"method": "ordinal", "table": _code_table(df.select(as_text(c).alias("v")), c, workdir)}


class Lookups:
    """Codes of column values, as literal maps or as columns joined in."""

    def __init__(self, spark: SparkSession):
        self.spark, self.joins = spark, []

    def code(self, key: Column, codes, kind: str, default) -> Column:
        """Code of ``key`` by ``codes``, a dict or the path of a code table."""
        if isinstance(codes, dict) and len(codes) <= LITERAL_LIMIT:
            got = F.element_at(_literal_map(codes, kind), key)
        else:
            alias = f"__code_{len(self.joins)}"
            if isinstance(codes, dict):          # at most MAP_LIMIT rows
                rows = self.spark.createDataFrame(list(codes.items()), f"v string, code {kind}")
                table = F.broadcast(rows)
            else:
                table = self.spark.read.parquet(codes)
            self.joins.append((key, table.select(F.col("v").alias(f"{alias}_v"), F.col("code").alias(alias))))
            got = F.col(alias)
        return F.coalesce(got, F.lit(default)).cast(kind)

    def join(self, df: DataFrame) -> DataFrame:
        for key, table in self.joins:
            df = df.join(table, key == F.col(table.columns[0]), "left")
        return df


def numbered(values: list) -> dict:
    return {v: i for i, v in enumerate(values)}


def _apply(df: DataFrame, state: dict) -> DataFrame:
    """One projection over literal maps and joined code columns."""
    look = Lookups(df.sparkSession)
    out_cols: list[Column] = []
    appended: list[Column] = []
    vectors = []
    for f in df.schema.fields:
        c = f.name
        st = state.get(c)
        if st is None:
            out_cols.append(F.col(c))
            continue
        m, text = st["method"], F.col(c).cast("string")
        if m == "ordinal":
            out_cols.append(look.code(as_text(c), st.get("table") or numbered(st["categories"]), "int", -1).alias(c))
        elif m == "frequency":
            out_cols.append(look.code(text, st.get("table") or st["freq"], "double", 0.0).alias(c))
        elif m == "onehot":
            for v, name in zip(st["categories"][1:], st["names"]):
                appended.append((as_text(c) == F.lit(v)).cast("double").alias(name))
        elif m == "onehot_vector":
            # code 0 (the dropped category) and unseen values: the index whose vector is empty
            code = look.code(as_text(c), st["table"], "int", 0)
            appended.append(F.when(code > 0, code - 1).otherwise(st["size"] - 1).cast("double").alias(f"__{st['name']}"))
            vectors.append(st)
        elif m == "binary":
            code = look.code(text, st.get("table") or st["codes"], "int", -1)
            for b, name in enumerate(st["names"]):
                out_cols.append(F.shiftright(code, b).bitwiseAND(F.lit(1)).alias(name))
    out = look.join(df).select(*out_cols, *appended)
    for st in vectors:
        index = f"__{st['name']}"
        one = df.sparkSession.createDataFrame([(float(st["size"] - 1),)], f"{index} double")
        out = OneHotEncoder(inputCols=[index], outputCols=[st["name"]]).fit(one).transform(out).drop(index)
    return out


def _reorder_target(df: DataFrame, target: str | None) -> DataFrame:
    if target and target in df.columns:
        return df.select(*[c for c in df.columns if c != target], target)
    return df


class Encoder(JsonEstimator):
    """ENC7: per-column encoding fitted on training data. ``config`` =
    {"target": str, "columns": {col: method}, "rule": "analysis"|"pipeline",
    "order_key": key for binary appearance order}. The target is never
    encoded and is moved last."""

    def _fit(self, df: DataFrame) -> "EncoderModel":
        with stats_input(df) as d:        # one pass per column: run an upstream shuffle once
            return self._fit_passes(d)

    def _fit_passes(self, df: DataFrame) -> "EncoderModel":
        cfg = self.conf
        target = cfg.get("target")
        cols = [c for c in string_columns(df) if c != target]
        methods = dict(cfg.get("columns") or {})
        todo = [c for c in cols if c not in methods]
        if todo:
            methods.update(recommend_encoding(df.select(*todo, *([target] if target else [])),
                                              target, cfg.get("rule", "analysis")))
        todo = {c: methods.get(c, "ordinal") for c in cols if methods.get(c, "ordinal") != "none"}
        state = _fit_batched(df, {c: m for c, m in todo.items()
                                  if m in ("ordinal", "label", "onehot", "frequency")})
        for c, m in todo.items():
            if c not in state:           # binary, or too many categories for a literal map
                state[c] = _fit_column(df, c, m, cfg.get("order_key"), cfg.get("workdir"))
        return EncoderModel(config=cfg, state={c: state[c] for c in todo})


class EncoderModel(JsonStateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return _reorder_target(_apply(df, self.fitted), self.conf.get("target"))


def encode(df: DataFrame, config: dict, target: str | None = None, order_key: str | None = None) -> DataFrame:
    """ENC3-ENC6: encode columns by an explicit ``{col: method}`` map."""
    model = Encoder({"target": target, "columns": config, "order_key": order_key}).fit(
        df.select(*[c for c in df.columns if c in config or c == target or c == order_key]))
    return model.transform(df)


# --------------------------------------------------------- ENC8 / ENC9 / ENC11
def encode_all_ordinal(df: DataFrame, target: str):
    """ENC8: ordinal-encode every text feature (codes as double, null as
    its own text category), leave numbers alone, target untouched and last.
    Returns ``(encoded_df, info_df)`` with the column lists."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    feats = [c for c in df.columns if c != target]
    text = [c for c in feats if isinstance(df.schema[c].dataType, T.StringType)]
    numeric = [c for c in feats if is_numeric_type(df.schema[c].dataType)]
    nun = distinct_counts(df, numeric, cap=2)
    binary = [c for c in numeric if nun[c] <= 2]
    plain = [c for c in numeric if c not in binary]
    skipped = [c for c in feats if c not in text and c not in numeric]
    state = _fit_batched(df, {c: "ordinal" for c in text})
    for c in text:
        if c not in state:               # too many categories: distributed code table
            state[c] = _fit_column(df, c, "ordinal", None, None)
    enc = _apply(df, state)
    enc = enc.select(*[F.col(c).cast("double").alias(c) if c in text else F.col(c) for c in enc.columns])
    enc = _reorder_target(enc, target)
    left = [c for c in enc.columns if c != target and isinstance(enc.schema[c].dataType, T.StringType)]
    if left:
        raise ValueError(f"text columns left after encoding: {left}")
    info = df.sparkSession.createDataFrame(
        [(c, "encoded") for c in text] + [(c, "numeric") for c in plain]
        + [(c, "binary") for c in binary] + [(c, "skipped") for c in skipped],
        "column_name string, role string")
    return enc, info


def encode_train_test(train: DataFrame, test: DataFrame, target: str | None = None):
    """ENC9: codes learned on train only (sorted non-null values), applied to
    both; missing and unseen -> -1; text codes long, numbers -> double."""
    if target and target in train.columns:
        raise ValueError("target must be separated before encoding")
    state = {}
    for c in string_columns(train):
        cats = _sorted_categories(train, c, null_as_text=False)
        state[c] = numbered(cats) if cats is not None else _code_table(
            train.select(F.col(c).alias("v")).where("v is not null"), c, None)

    def apply(df):
        look, out = Lookups(df.sparkSession), []
        for f in df.schema.fields:
            c = f.name
            if c in state:
                out.append(look.code(F.col(c), state[c], "long", -1).alias(c))
            elif is_numeric_type(f.dataType):
                out.append(F.col(c).cast("double").alias(c))
            else:
                out.append(F.col(c))
        return look.join(df).select(*out)
    return apply(train), apply(test)


def encode_target(df: DataFrame, target: str, out: str | None = None):
    """ENC11: target label -> 0..n-1 by sorted text; returns
    ``(df, classes)`` where ``classes[i]`` is the label of code i."""
    codes = _sorted_categories(df, target, null_as_text=False)
    if codes is not None:
        cats, codes = codes, numbered(codes)
    else:
        codes = _code_table(df.select(F.col(target).cast("string").alias("v")).where("v is not null"), target, None)
        rows = df.sparkSession.read.parquet(codes).orderBy("code").limit(CLASS_LIMIT + 1).collect()
        if len(rows) > CLASS_LIMIT:
            raise ValueError(f"target {target!r} has more than {CLASS_LIMIT} classes; not a classification target")
        cats = [r["v"] for r in rows]
    look = Lookups(df.sparkSession)
    key = F.col(target).cast("string")
    col = look.code(key, codes, "int", None).alias(out or target)
    keep = [F.col(c) for c in df.columns if c != target or out]
    return look.join(df).select(*keep, col), cats
