"""Readers and writers of documents, catalogues, memories, reports and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = "defaultTargets array<string>, languages map<string, struct<name:string,translator:string,formal:string,informal:string,style:string,wrap:string,lengthRatio:array<double>>>"
GLOSSARY = "doNotTranslate array<string>, terms map<string, map<string,string>>"
MEMORY = "doc string, lang string, tm map<string,string>"


def documents(spark: SparkSession, path: str, pattern: str = "*.{md,mdx}") -> DataFrame:
    """doc, content, mdx of all files below path. Bytes that are no UTF-8 raise; a byte order mark stays."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "UTF-8")
    return raw.select(F.col("path").alias("doc"), text.alias("content"), F.col("path").endswith(".mdx").alias("mdx"))


def request(spark: SparkSession, files: dict[str, str], most: int = 500, longest_name: int = 512) -> DataFrame:
    """Documents of one request: 1 to ``most`` names of 1 to ``longest_name`` characters with string contents."""
    if not isinstance(files, dict) or not files or len(files) > most:
        raise ValueError(f"1 to {most} files are allowed")
    for name, content in files.items():
        if not name or len(name) > longest_name or not isinstance(content, str):
            raise ValueError(f"bad file {name[:40]!r}")
    return spark.createDataFrame([(k, v, k.endswith(".mdx")) for k, v in files.items()], "doc string, content string, mdx boolean")


def languages(spark: SparkSession, path: str) -> DataFrame:
    """code, is_default and the settings of every language; codes in lower case.

    A default target that the catalogue does not hold is an error.
    """
    row = spark.read.schema(LANGUAGES).option("multiLine", "true").json(path)
    lost = row.select(F.array_except(F.transform("defaultTargets", F.lower), F.transform(F.map_keys("languages"), F.lower)).alias("x")).first()
    if lost and lost["x"]:
        raise ValueError(f"default targets without an entry: {', '.join(lost['x'])}")
    return row.select("defaultTargets", F.explode("languages").alias("code", "v")).select(F.lower("code").alias("code"), F.array_contains("defaultTargets", F.col("code")).alias("is_default"), "v.*")


def glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dnt: term; terms: term, lang, text)."""
    row = spark.read.schema(GLOSSARY).option("multiLine", "true").json(path)
    dnt = row.select(F.explode("doNotTranslate").alias("term")).distinct()
    terms = row.select(F.explode("terms").alias("term", "m")).select("term", F.explode("m").alias("lang", "text"))
    return dnt, terms


def memory(spark: SparkSession, path: str) -> DataFrame:
    """doc, lang, seg_id, text of saved translation memories (JSON lines).

    tm is an object of ids or a list of [id, text]; other fields, as reports have them, are not read. A null
    text is left out; of an id that stands twice in a list the last counts.
    """
    raw = spark.read.schema("doc string, lang string, tm string").json(path)
    listed = F.from_json("tm", "array<array<string>>")
    pairs = F.coalesce(F.map_entries(F.from_json("tm", "map<string,string>")), F.transform(listed, lambda x: F.struct(x[0].alias("key"), x[1].alias("value"))))
    rows = raw.select("doc", "lang", F.posexplode(pairs).alias("at", "e")).where("e.key IS NOT NULL AND e.value IS NOT NULL")
    return rows.groupBy("doc", "lang", F.col("e.key").alias("seg_id")).agg(F.max_by("e.value", "at").alias("text"))


# The fields of an analysis, as it is answered and saved.
ANALYSIS = (
    "sourceLanguage string, register string, registerEvidence string, domain string, audience string, summary string, doNotTranslate array<string>, "
    "terminology array<struct<term:string,note:string>>"
)


def analysis_columns(a: Column) -> list[Column]:
    """language, register, register_evidence, domain, audience, summary, dnt, terminology of an analysis; a register that is none is null."""
    register = F.when(a["register"].isin("formal", "informal", "neutral"), a["register"])
    names = (("sourceLanguage", "language"), ("registerEvidence", "register_evidence"), ("domain", "domain"), ("audience", "audience"), ("summary", "summary"), ("doNotTranslate", "dnt"), ("terminology", "terminology"))
    return [register.alias("register"), *(a[field].alias(column) for field, column in names)]


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """doc (null where the file names none) and what an earlier analysis found; one JSON object a line, or a file that is one."""
    lines = spark.read.text(path, wholetext=True)
    objects = F.split(F.trim("value"), r"(?<=\})\s*\n\s*(?=\{)")
    return lines.select(F.explode(objects).alias("o")).select(F.from_json("o", f"doc string, {ANALYSIS}").alias("a")).select("a.doc", *analysis_columns(F.col("a")))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path).withColumn("file", F.input_file_name())


def write_documents(assembled: DataFrame, path: str) -> None:
    assembled.write.mode("overwrite").partitionBy("lang").parquet(path)


def write_report(reports: DataFrame, path: str, outcomes: DataFrame | None = None) -> None:
    """One JSON object a document and language; with outcomes, also its translations in document order and how
    each segment came about."""
    if outcomes is not None:
        number = F.regexp_extract("seg_id", r"(\d+)", 1).cast("int")
        rows = F.array_sort(F.collect_list(F.struct(number.alias("seq"), "seg_id", "kind", "via", "retries", "errors", "text")))
        per = outcomes.groupBy("doc", "lang").agg(rows.alias("__r"))
        tm = F.transform(F.filter("__r", lambda r: r["text"].isNotNull()), lambda r: F.array(r["seg_id"], r["text"]))
        reports = reports.join(per.select("doc", "lang", tm.alias("tm"), F.transform("__r", lambda r: r.dropFields("seq", "text")).alias("segments_detail")), ["doc", "lang"], "left")
    reports.write.mode("overwrite").json(path)


def extraction_dump(segments: DataFrame, docs: DataFrame, doc: str = "doc", content: str = "content") -> DataFrame:
    """doc, json of each document's segments in order, with byte offsets of what they replace."""
    d = docs.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("__c"))
    byte = lambda at: F.octet_length(F.substring(F.col("__c"), F.lit(1), at))
    rows = segments.join(d, "doc").select("doc", F.struct("seq", F.col("seg_id").alias("id"), "kind", "note", "masked", "original", "passive", byte(F.col("start")).alias("start"), byte(F.col("end")).alias("end")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda x: x.dropFields("seq"))
    return rows.groupBy("doc").agg(F.to_json(F.struct(listed.alias("segments"))).alias("json"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds raw results (doc, lang, variant, fingerprint, ...) to the store that a resumed run reads."""
    runs.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("doc", "lang", "variant", "fingerprint")) -> DataFrame:
    """One result a key; writers that were started twice may have stored it twice."""
    return spark.read.schema(schema).parquet(path).dropDuplicates(list(keys))


def write_csv(df: DataFrame, path: str) -> None:
    """Header from the columns; nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def append_cache(outcomes: DataFrame, path: str) -> None:
    """Adds new translations to the cache table; keys are content hashes, so a repeated write adds nothing new."""
    fresh = outcomes.where("via NOT IN ('cache','source') AND text IS NOT NULL").select("key", "text").dropDuplicates(["key"])
    fresh.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, text string").parquet(path).groupBy("key").agg(F.min("text").alias("text"))
