"""Languages and their pages' addresses, and the files of evaluation runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Languages, the words of their headings (finer levels first), and where their pages are.
@dataclass(frozen=True)
class Language:
    code: str
    article: str
    headings: dict[str, tuple[str, ...]]


LANGUAGES = {
    "en": Language("en", "Article", {"PART": ("PART",), "TITLE": ("TITLE",), "CHAPTER": ("CHAPTER",), "SECTION": ("SUB-SECTION", "SUBSECTION", "SECTION")}),
    "it": Language("it", "Articolo", {"PART": ("PARTE",), "TITLE": ("TITOLO",), "CHAPTER": ("CAPO",), "SECTION": ("SOTTOSEZIONE", "SEZIONE")}),
    "pl": Language("pl", "Artykuł", {"PART": ("CZĘŚĆ",), "TITLE": ("TYTUŁ",), "CHAPTER": ("ROZDZIAŁ",), "SECTION": ("PODSEKCJA", "SEKCJA")}),
}
PAGE = "https://eur-lex.europa.eu/legal-content/%s/TXT/HTML/?uri=CELEX:%s"
DOCUMENT = "02013R0575-20260101"
# Columns that must not reach an embedding.
NOT_EMBEDDED = (
    "node_id", "level", "annex_id", "annex_title", "referenced_articles", "referenced_external", "referenced_annexes", "referenced_parts", "referenced_titles",
    "referenced_chapters", "referenced_sections", "has_table", "has_formula", "sub_article_of", "chunk_type", "parent_article_id", "para_id", "display_text", "best_paragraph",
)


def language(code: str) -> Language:
    """What a language's documents look like; an error for an unknown one."""
    if code not in LANGUAGES:
        raise ValueError(f"unsupported language {code!r}; supported: {', '.join(LANGUAGES)}")
    return LANGUAGES[code]


def page_address(code: Column, document: Column) -> Column:
    """Where a document's page in a language is; NULL for an unknown language."""
    return F.when(code.isin(*LANGUAGES), F.format_string(PAGE, F.upper(code), document))


def embedded(nodes: DataFrame) -> DataFrame:
    """The columns that may be embedded."""
    return nodes.drop(*NOT_EMBEDDED)


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(conf), target


def write_state(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside, then named."""
    jvm, fs, target = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # A local or distributed file system's rename doesn't replace, so the context's own does.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, made by ``build()`` first where there is none: only a finished write counts."""
    jvm, fs, target = _files(spark, path)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder of runs, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def runs(files: DataFrame) -> DataFrame:
    """(run, complete) from (name): complete with a summary and cases, incomplete with a state but no summary."""
    parts = files.select(F.regexp_extract("name", r"^(.*)_(summary\.json|cases\.jsonl|state\.json)$", 1).alias("run"), F.regexp_extract("name", r"_(summary|cases|state)\.jsonl?$", 1).alias("kind"))
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    by_run = parts.where("run <> ''").groupBy("run").agg(*(has(k).alias(k) for k in ("summary", "cases", "state")))
    return by_run.where("(summary and cases) or (state and not summary)").select("run", F.col("summary").alias("complete"))


def read_pages(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """(page_id, url, language, html) of HTML files: bytes that aren't UTF-8 become replacement characters; the id is a hash of the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.lit(language).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
