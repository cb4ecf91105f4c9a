"""Small literal tables."""

from masteria.schema import MODEL, SKILL
from pyspark.sql import types as T

MODEL_ORD = T.StructType(MODEL.fields + [T.StructField("ord", T.LongType())])
ITEM = "item_id long, skill_id long, benchmark string, text string, alpha double, beta double"
RESPONSE = "model_id long, item_id long, correct long"


def models(spark, *rows):
    """Rows as dicts; what is not given is null, ord defaults to the place in the list."""
    full = [{"ord": i, "name": f"m{r['id']}", "family": "Llama", "tier": "Small", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in MODEL_ORD.fields) for r in full], MODEL_ORD)


def skills(spark, *rows):
    full = [{"label": f"skill {r['id']}", "primary_benchmark": "MATH", "n_items": 5, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in SKILL.fields) for r in full], SKILL)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE)


def rows(frame, *columns, by=None):
    columns = columns or tuple(frame.columns)
    got = [tuple(r) for r in frame.select(*columns).collect()]
    return sorted(got, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))
