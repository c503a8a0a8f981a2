"""The persisted store: schemas, the JSON document it may come from, and atomic replacement."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import NO_DIAGNOSTICS, safe_stem, source_name

SEGMENT = "struct<page_index:int,image_path:string,left_ratio:double,top_ratio:double,right_ratio:double,bottom_ratio:double,pixel_width:int,pixel_height:int>"
CATEGORIES = "id string, name string"
QUESTIONS = f"id string, index int, category_id string, source_file string, type string, prompt string, choices array<string>, correct_answers array<string>, image_segments array<{SEGMENT}>, image_path string, image_top_ratio double, image_bottom_ratio double"
WRONG = "question_id string"
# Field names of the JSON document.
STATE_JSON = """Categories array<struct<Id:string,Name:string>>, Questions array<struct<Id:string,Index:int,CategoryId:string,SourceFileName:string,Type:int,Prompt:string,Choices:array<string>,CorrectAnswers:array<string>,
ImageSegments:array<struct<PageIndex:int,ImagePath:string,LeftRatio:double,TopRatio:double,RightRatio:double,BottomRatio:double,PixelWidth:int,PixelHeight:int>>,ImagePath:string,ImageTopRatio:double,ImageBottomRatio:double>>, WrongQuestionIds array<string>"""
KINDS = ["MC", "SUBJ"]


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Categories, questions and wrong ids of a JSON document; empty if it is missing or blank; malformed JSON fails."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p) or spark.read.text(path).where("trim(value) <> ''").isEmpty():
        return {
            "categories": spark.createDataFrame([], CATEGORIES), "questions": spark.createDataFrame([], QUESTIONS),
            "wrong_questions": spark.createDataFrame([], WRONG)
        }
    state = spark.read.schema(STATE_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    c = state.select(
        F.inline(F.coalesce("Categories", F.array().cast(state.schema["Categories"].dataType)))
    ).select(F.col("Id").alias("id"), F.coalesce("Name", F.lit("")).alias("name"))
    q = state.select(F.inline("Questions"))
    none = F.array().cast("array<string>")
    questions = q.select(
        F.lower("Id").alias("id"), F.col("Index").alias("index"), F.coalesce("CategoryId", F.lit("")).alias("category_id"), F.coalesce("SourceFileName", F.lit("")).alias("source_file"),
        F.get(
            F.array(*map(F.lit, KINDS)), F.coalesce("Type", F.lit(0))
        ).alias("type"), F.coalesce("Prompt", F.lit("")).alias("prompt"), F.coalesce("Choices", none).alias("choices"), F.coalesce("CorrectAnswers", none).alias("correct_answers"),
        stored_segments(
            F.col("ImageSegments"), F.col("ImagePath"), F.coalesce("ImageTopRatio", F.lit(0.0)),
            F.coalesce("ImageBottomRatio", F.lit(1.0))
        ).alias("image_segments"),
        F.col("ImagePath").alias("image_path"), F.coalesce("ImageTopRatio", F.lit(0.0)).alias("image_top_ratio"), F.coalesce(
            "ImageBottomRatio", F.lit(1.0)
        ).alias("image_bottom_ratio"),
    )
    wrong = state.select(F.explode(F.coalesce("WrongQuestionIds", none)).alias("question_id")).select(F.lower("question_id").alias("question_id"))
    return {"categories": c, "questions": questions, "wrong_questions": wrong}


def stored_segments(segments, path, top, bottom):
    """The segments, or the one that an older image path stands for, or none."""
    cast = segments.cast(f"array<{SEGMENT}>")
    one = F.array(
        F.struct(
            F.lit(1).alias("page_index"), path.alias("image_path"), F.lit(0.0).alias("left_ratio"), top.alias("top_ratio"),
            F.lit(1.0).alias("right_ratio"), bottom.alias("bottom_ratio"), F.lit(0).alias("pixel_width"),
            F.lit(0).alias("pixel_height")
        )
    ).cast(f"array<{SEGMENT}>")
    return F.when(
        F.size(F.coalesce(cast, F.array().cast(f"array<{SEGMENT}>"))) > 0, cast
    ).when(F.coalesce(path, F.lit("")).rlike(r"\S"), one).otherwise(F.array().cast(f"array<{SEGMENT}>"))


POINTER = "current.json"


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """The tables as parquet in ``folder``, all or none of them replaced at once.

    Each is written to a folder of its own; then one small file that names the folder of
    every table is replaced by renaming, which is atomic. Readers see the old or the new
    tables whole, and a failure leaves the old ones. Folders that no table has any more are
    deleted a version later, so that readers that have begun can end.
    """
    old = current(spark, folder)
    new = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{new[name]}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs, pointer = filesystem(spark, f"{folder}/{POINTER}")
    written = path(f"{folder}/{POINTER}-{uuid.uuid4().hex}")
    state = {"tables": {**old["tables"], **new}, "before": [old["tables"][n] for n in new if n in old["tables"]]}
    out = fs.create(written, False)
    out.write(json.dumps(state).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(written), fs.makeQualified(pointer), options)
    for name in old["before"]:
        if name not in state["tables"].values():
            fs.delete(path(f"{folder}/{name}"), True)


def current(spark: SparkSession, folder: str) -> dict:
    """Which folder each table is in, and those that the last version replaced."""
    fs, pointer = filesystem(spark, f"{folder}/{POINTER}")
    if not fs.exists(pointer):
        return {"tables": {}, "before": []}
    return json.loads(spark.read.text(f"{folder}/{POINTER}", wholetext=True).first()[0])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{current(spark, folder)['tables'][name]}")


def key_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each answer-key file: key_id (its path) and key_text (all of it)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("key_id"), F.col("value").alias("key_text"))


def replace_parts(df: DataFrame, folder: str, key: str, touched: DataFrame | None = None, kind: str = "parquet") -> None:
    """``df``'s parts, one for each value of ``key``, in place of those that ``folder`` has; all its other parts stay as they are.

    The new parts are written to a version of their own. Which version has a key's part is a
    table that save() replaces by one rename, so readers see all the old or all the new
    parts, a failure leaves the old ones, and no part that isn't touched is read or written.
    ``touched`` (key) are the keys that are replaced, those in ``df`` if not given; one without
    rows in ``df`` is emptied. Versions that neither the new table nor the one before it names
    are deleted. A null key is the empty one. One writer at a time.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    named = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("")))
    path = f"{folder}/parts/version={version}"
    # a part's folder is named by its key's digest, as names may hold anything and differ in case alone
    digest = F.concat(F.lit("k-"), F.md5(key))
    rows = named.withColumn("part", digest)
    if kind == "text":
        rows = rows.drop(key)
    rows.write.partitionBy("part").format(kind).save(path)
    mine = (named if touched is None else touched).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).distinct()
    new = mine.select(key, digest.alias("part"), F.lit(version).alias("version"))
    old = current(spark, folder)["tables"]
    if "parts" in old:
        before = load(spark, folder, "parts")
        new = new.unionByName(before.join(mine, key, "left_anti"))
    save(spark, folder, {"parts": new})
    # one name for each import that still has a part
    held = {r[0] for r in load(spark, folder, "parts").select("version").distinct().collect()}
    held |= {r[0] for r in before.select("version").distinct().collect()} if "parts" in old else set()
    fs, parts = filesystem(spark, f"{folder}/parts")
    for status in fs.listStatus(parts):
        if status.getPath().getName().removeprefix("version=") not in held:
            fs.delete(status.getPath(), True)


def read_parts(spark: SparkSession, folder: str, schema: str, key: str, kind: str = "parquet", wholetext: bool = False) -> DataFrame:
    """All rows of the parts that are current; ``schema`` is that of what was written but for the key where ``kind`` is text. Nothing if nothing was written."""
    whole = T.StructType.fromDDL(f"{schema}, part string, version string")
    if "parts" not in current(spark, folder)["tables"]:
        return spark.createDataFrame([], whole).withColumn(key, F.lit(None).cast("string")).drop("part", "version")
    reader = spark.read.schema(whole)
    # the paths name part and version, which the schema keeps from being taken for numbers
    found = (reader.text(f"{folder}/parts", wholetext=wholetext) if kind == "text" else reader.format(kind).load(f"{folder}/parts"))
    names = load(spark, folder, "parts")
    if kind == "text":
        return found.join(names, ["part", "version"]).drop("part", "version")
    return found.join(names.drop(key), ["part", "version"], "left_semi").drop("part", "version")


def write_by_file(df: DataFrame, folder: str, kind: str = "parquet", files: DataFrame | None = None) -> None:
    """An analysis or its diagnostics, one part for each source file; files that aren't in ``files`` (by default in ``df``) keep theirs. See replace_parts()."""
    replace_parts(df, folder, "source_file", files, kind)


def read_by_file(spark: SparkSession, folder: str, schema: str, kind: str = "parquet") -> DataFrame:
    """What write_by_file() has written of all files; ``schema`` as it was written."""
    return read_parts(spark, folder, schema, "source_file", kind)


def write_reports(reports: DataFrame, folder: str) -> None:
    """Diagnosis texts (source_file, text), one text file in a part for each file's safe stem; other files' texts stay."""
    replace_parts(reports.select(safe_stem("source_file").alias("stem"), "text"), folder, "stem", kind="text")


def read_reports(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(source_file, text) for each of ``files``: its written text, or what stands for none."""
    wanted = files.select("source_file", safe_stem("source_file").alias("stem"))
    found = read_parts(spark, folder, "value string", "stem", "text", wholetext=True).select(F.rtrim("value", F.lit("\n")).alias("text"), "stem")
    return wanted.join(found, "stem", "left").select("source_file", F.coalesce("text", F.lit(NO_DIAGNOSTICS)).alias("text"))


def save_questions(touched: DataFrame, folder: str, groups: DataFrame) -> None:
    """The questions of some categories' files in place of those stored; all other groups' parts are neither read nor written.

    ``touched`` are the groups' questions after an import, ``groups`` (category_id,
    source_file) all that it touched, also those of which nothing is left.
    """
    replace_parts(touched.withColumn("group", group_key()), folder, "group", groups.select(group_key().alias("group")))


def load_questions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All stored questions; ``schema`` as they were saved."""
    return read_parts(spark, folder, f"{schema}, group string", "group").drop("group")


def group_key():
    """What the questions of a category's file share: its id, and the file's name without regard to case."""
    return F.to_json(F.array("category_id", F.lower(source_name("source_file"))))
