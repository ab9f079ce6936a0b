"""From cleaned loans to model features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_bucket, experience_bucket, gender_code, number_or_null
from ..schemas import CATEGORICAL, FEATURES, LABEL, NUMERIC

# A null category is a level of its own, as any other value is.
_NO_VALUE = "nan"


def check_columns(columns: list[str], required: list[str]) -> None:
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"training needs the columns {missing}")


def drop_incomplete(table: DataFrame) -> DataFrame:
    """Reads the numeric columns and drops rows lacking one of them or the label."""
    numbers = {c: number_or_null(F.col(c)) for c in NUMERIC}
    return table.withColumns(numbers).na.drop(subset=[LABEL, *NUMERIC])


def encode(table: DataFrame) -> DataFrame:
    """The features as the models take them, for training and scoring alike."""
    texts = {
        "person_age": age_bucket(F.col("person_age")),
        "person_gender": gender_code(F.col("person_gender")),
        "person_emp_exp": experience_bucket(F.col("person_emp_exp")),
    }
    for c in CATEGORICAL:
        texts[c] = F.coalesce(texts.get(c, F.col(c)).cast("string"), F.lit(_NO_VALUE))
    numbers = {c: number_or_null(F.col(c)) for c in NUMERIC}
    return table.withColumns({**texts, **numbers})


def training_table(loans: DataFrame, key: str | None = "loan_id") -> DataFrame:
    """Encoded features and integer label of the complete rows."""
    check_columns(loans.columns, [*FEATURES, LABEL])
    rows = encode(drop_incomplete(loans))
    keep = [key] if key else []
    return rows.select(*keep, *FEATURES, F.col(LABEL).cast("int").alias(LABEL))


def _logged(column: str) -> str:
    finite = f"if(abs({column}) = double('inf'), raise_error('infinite {column}'), {column})"
    return f"log1p({finite})"


def log_features(table: DataFrame) -> DataFrame:
    return table.withColumns({f"{c}_log": F.expr(_logged(c)) for c in NUMERIC})


def fit_scaler(table: DataFrame) -> SQLTransformer:
    """Standardised log features, with the population deviation of `table`.

    A constant feature is only centred.
    """
    logs = [F.expr(_logged(c)).alias(c) for c in NUMERIC]
    stats = table.select(*logs).agg(
        *(F.avg(c).alias(f"{c}_mean") for c in NUMERIC),
        *(F.stddev_pop(c).alias(f"{c}_std") for c in NUMERIC),
    ).first()
    if stats[0] is None:
        raise ValueError("no complete rows to fit on")
    scaled = (
        f"({_logged(c)} - {stats[f'{c}_mean']!r}D) / {stats[f'{c}_std'] or 1.0!r}D AS {c}_scaled"
        for c in NUMERIC
    )
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def one_hot() -> Pipeline:
    """Every level seen in fitting gets a slot; any other value sets none."""
    indexer = StringIndexer(
        inputCols=CATEGORICAL,
        outputCols=[f"{c}_index" for c in CATEGORICAL],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    # The indexer's extra index for unseen values is the one the encoder drops.
    encoder = OneHotEncoder(
        inputCols=indexer.getOutputCols(),
        outputCols=[f"{c}_hot" for c in CATEGORICAL],
        dropLast=True,
    )
    return Pipeline(stages=[indexer, encoder])


def fit_preprocessor(train: DataFrame) -> PipelineModel:
    """Adds `features`: scaled numbers first, then the one-hot categories."""
    inputs = [f"{c}_scaled" for c in NUMERIC] + [f"{c}_hot" for c in CATEGORICAL]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return Pipeline(stages=[fit_scaler(train), one_hot(), assembler]).fit(train)


def level_counts(preprocessor: PipelineModel) -> list[int]:
    """How many levels each category has."""
    return [len(labels) for labels in preprocessor.stages[1].stages[0].labelsArray]


def compact_rows(preprocessor: PipelineModel, rows: DataFrame, *also: str | Column) -> DataFrame:
    """`numbers` (scaled) and `levels` (the place of each category's level, as many as it has
    levels for one that is none of them) of every row: thirteen values instead of a slot per
    level."""
    ready = PipelineModel([preprocessor.stages[0], preprocessor.stages[1].stages[0]]).transform(rows)
    return ready.select(
        *also,
        F.array(*(F.col(f"{c}_scaled") for c in NUMERIC)).alias("numbers"),
        F.array(*(F.col(f"{c}_index").cast("int") for c in CATEGORICAL)).alias("levels"),
    )


def sparse_features(levels_of: list[int]) -> Column:
    """The slots of `numbers`, `levels`, `other_levels` and `share` as a vector is stored: the
    numbers, then of each category the slots of one level or two."""
    starts, width = [], len(NUMERIC)
    for n in levels_of:
        starts.append(width)
        width += n
    slot = "struct(CAST({start} + {level} AS INT) AS i, {weight} AS x)"
    parts = [f"struct({i} AS i, numbers[{i}] AS x)" for i in range(len(NUMERIC))]
    for c, (start, n) in enumerate(zip(starts, levels_of)):
        for column, weight in (("levels", f"if(levels[{c}] = other_levels[{c}], 1.0D, 1.0D - share)"),
                               ("other_levels", f"if(levels[{c}] = other_levels[{c}], 0.0D, share)")):
            level = f"{column}[{c}]"
            parts.append(f"if({level} < {n}, {slot.format(start=start, level=level, weight=weight)}, NULL)")
    slots = f"array_sort(filter(array({', '.join(parts)}), s -> s IS NOT NULL AND s.x <> 0))"
    return F.expr(
        f"struct(CAST(0 AS TINYINT) AS type, {width} AS size, transform({slots}, s -> s.i) AS indices,"
        f" transform({slots}, s -> s.x) AS values)"
    )
