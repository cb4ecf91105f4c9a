"""The given tables, read as the tables of this library.

Each function derives one table from whole input tables by row-wise rules or a grouping. Theta
is a multiple of 1/1024, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masteria.operators.responses import attach_accuracy
from masteria.operators.skillmap import skill_pca_map
from masteria.operators.taxonomy import skill_statistics
from masteria.sources.readers import responses_long


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def models(spark: SparkSession, folder: str) -> DataFrame:
    """One model per embedding; its coordinates give theta, with some values missing."""
    vec = F.col("vec_id")
    family = F.array(*[F.lit(f) for f in (
        "Llama", "Qwen", "Mistral", "Gemma", "Phi", "Mixtral", "Other", "Falcon", "Llama", "Qwen")])
    params = F.when(vec % 5 != 0, (vec * 7 % 140) / 2)

    def theta(e: Column, i: Column) -> Column:
        scaled = F.floor((e.cast("double") + 0.5) * 1024) / F.lit(1024.0)
        return F.when((vec * 64 + i) % 97 != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))

    rows = table(spark, folder, "embeddings").select(
        vec.alias("id"),
        F.concat(F.when(vec % 2 == 0, "Model-").otherwise("model_"), vec.cast("string")).alias("name"),
        F.when(vec % 13 != 0, hub_id(vec)).alias("hf_id"),
        F.get(family, F.col("label")).alias("family"),
        params.alias("params"),
        F.transform("embedding", theta).alias("theta"))
    tier = (F.when(F.col("params").isNull(), "Other").when(F.col("params") < 10, "Small")
            .when(F.col("params") < 40, "Mid").otherwise("Large"))
    return rows.withColumn("tier", tier)


def hub_id(number: Column) -> Column:
    return F.concat(F.lit("org__m__"), number.cast("string"))


def respondents(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(key.alias("pos"), hub_id(key).alias("hf_id"))


def scored_models(spark: SparkSession, folder: str) -> DataFrame:
    """Models with the accuracy of their responses; models without responses have none."""
    return attach_accuracy(models(spark, folder), responses(spark, folder), respondents(spark, folder))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One item per part; LARGE gives a benchmark that is not one of the known ones."""
    key, kind = F.col("p_partkey"), F.col("p_type")
    benchmark = (F.when(kind == "ECONOMY", "MATH").when(kind == "STANDARD", "BBH").when(kind == "PROMO", "GPQA")
                 .when(kind == "SMALL", "MuSR").when(kind == "MEDIUM", "IFEval").otherwise("ARC"))
    return table(spark, folder, "part").select(
        key.alias("item_id"), F.col("p_size").cast("bigint").alias("skill_id"), benchmark.alias("benchmark"),
        F.col("p_name").alias("text"), ((key % 32) / 32 + 0.5).alias("alpha"), ((key % 17) / 16).alias("beta"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per supplier and part: right if any of their lines was not returned."""
    right = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("model_id"), F.col("l_partkey").alias("item_id"),
    ).agg(F.max(right).cast("bigint").alias("correct"))


def skills(spark: SparkSession, folder: str) -> DataFrame:
    """Every position of the theta arrays, with the statistics of its items; some have none."""
    known = skill_statistics(items(spark, folder))
    return theta_skills(spark, folder).join(known, "id", "left").select(
        "id", "primary_benchmark", F.coalesce("n_items", F.lit(0)).alias("n_items"), "alpha_mean")


def theta_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Every position that occurs in a theta array, also those without items."""
    return (table(spark, folder, "embeddings").select(F.posexplode("embedding").alias("id", "e"))
            .select(F.col("id").cast("bigint").alias("id")).distinct())


def catalogue(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> DataFrame:
    """One catalogue entry per document: its text is the label, translated for some languages,
    and the description repeats the label, repeats the heading or differs. ``documents`` may name the table in another order."""
    doc, text, lang = F.col("doc_id"), F.col("text"), F.col("lang")
    source = F.col("source")
    benchmark = (F.when(source == "src3", "MATH").when(source == "src1", "BBH").when(source == "src4", "GPQA")
                 .when(source == "src0", "MuSR").when(source == "src2", "IFEval").otherwise(source))
    english = (F.when(lang == "fr", F.concat(F.lit("Translated: "), text)).when(lang == "de", text)
               .when(lang == "es", ""))
    heading = F.coalesce(english, text)
    description = (F.when(doc % 3 == 0, F.concat(F.lit(" \t"), F.replace(text, F.lit(" "), F.lit("  \n")), F.lit("\n ")))
                   .when(doc % 3 == 1, F.concat(heading, F.lit("…")))
                   .otherwise(F.concat(F.lit("About "), text)))
    documents = table(spark, folder, "documents") if documents is None else documents
    return documents.select(
        doc.alias("id"), text.alias("label"), english.alias("label_english"),
        F.when(lang != "en", lang).alias("language"), description.alias("description"),
        benchmark.alias("primary_benchmark"), F.floor(F.col("n_chars") / 100).cast("bigint").alias("n_items"))


def catalogue_with_examples(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> DataFrame:
    """Catalogue entries with nested example items: the paragraphs of the document, with ids that fall
    along the list; Spanish ones have an empty list."""
    spanish = F.coalesce(F.col("language"), F.lit("")) == "es"
    texts = F.when(spanish, F.array().cast("array<string>")).otherwise(F.split("label", "\n"))
    examples = F.transform(texts, lambda t, i: F.struct(
        (F.size(F.split("label", "\n")) - i).cast("bigint").alias("item_idx"), F.col("primary_benchmark").alias("benchmark"),
        F.lit(None).cast("string").alias("subtask"), F.lit(None).cast("string").alias("primary_skill"),
        t.alias("text")))
    return catalogue(spark, folder, documents).withColumn("example_items", examples)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One comparison request per customer, with words, blanks, repeats and unknown ids among
    the ids asked for."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    csv = F.concat(
        F.lit(" "), (key % 700).cast("string"), F.when(nation % 3 == 0, F.lit("abc,x,,")).otherwise(F.lit(",")),
        nation.cast("string"), F.lit(","), (key * 3 % 800).cast("string"), F.lit(",1"))
    return table(spark, folder, "customer").select(key.alias("request_id"), csv.alias("m"))


def answer_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """A dense right-or-wrong matrix: one array of answers per embedding."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("pos"), F.transform("embedding", lambda e: (e > 0).cast("int")).alias("answers"))


def dense_responses(spark: SparkSession, folder: str) -> DataFrame:
    return responses_long(answer_matrix(spark, folder))


def placed_models(spark: SparkSession, folder: str) -> DataFrame:
    """The models with ids that are not their positions; ``answer_matrix`` has their responses."""
    return models(spark, folder).withColumns({"ord": F.col("id"), "id": F.col("id") * 3 + 7})


def placed_respondents(spark: SparkSession, folder: str) -> DataFrame:
    return placed_models(spark, folder).select(F.col("ord").alias("pos"), "hf_id")


def map_points(spark: SparkSession, folder: str) -> DataFrame:
    """The skills on a plane, by their principal components."""
    placed = skill_pca_map(models(spark, folder), theta_skills(spark, folder))
    return placed.select(F.col("skill_id").alias("id"), "x", "y")
