"""Readers of files and folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Folders that a walk leaves out.
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")


def walk(spark: SparkSession, path: str, pattern: str = "**/*", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, name, size, mtime) of files below a folder whose path from there fits the glob; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Spark gives paths in full, with their scheme; what is before the folder has a known length.
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    rel = F.substring(F.col("path"), len(root) + 2, 1 << 30)
    hidden = F.exists(F.split(rel, "/"), lambda p: p.isin(*ignored))
    out = files.select(rel.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), hidden.alias("hidden"))
    return out.filter(~F.col("hidden") & F.col("path").rlike(X.glob_to_regex(pattern))).drop("hidden")


def page(rows: DataFrame, limit: int, offset: int = 0, order: list | None = None) -> DataFrame:
    """A page of rows, and in ``more`` whether others follow."""
    cut = rows.orderBy(*order) if order else rows
    got = cut.offset(offset).limit(limit + 1)
    return got.withColumn("more", F.count("*").over(_all()) > limit).limit(limit)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def is_binary(content: Column) -> Column:
    """A NUL byte, or more than a fifth of control bytes, in the first 4,096."""
    hexed = F.hex(F.substring(content, 1, 4096))
    bytes_ = F.regexp_extract_all(hexed, F.lit("(..)"), 1)
    control = F.size(F.filter(bytes_, lambda b: b.rlike("^(0[0-8BCEF]|1[0-9A-F])$")))
    return F.array_contains(bytes_, "00") | (control > 0.2 * F.size(bytes_))


def mime(content: Column) -> Column:
    """Kind of an image by its first bytes; null for others."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")


def text_document(docs: DataFrame, text: str) -> DataFrame:
    """Title, language, pages of 3,000 characters, $...$ formulas and # sections of plain texts."""
    t = F.col(text)
    formulas = F.regexp_extract_all(t, F.lit(r"\$([^$\n]+)\$"), 1)
    heads = F.regexp_extract_all(t, F.lit(r"(?m)^(#{1,6}) "), 1)
    return docs.withColumns(
        {
            "title": X.title(t),
            "language": X.language(t),
            "page_count": F.greatest(F.lit(1), F.floor(F.length(t) / 3000)).cast("long"),
            "formulas": formulas,
            "formula_count": F.size(formulas).cast("long"),
            "section_count": F.size(heads).cast("long"),
        }
    )


def page_range(spec: Column, pages: Column) -> Column:
    """"2-5" or "3" as (first, last), counted from 0 and kept within the pages."""
    first = F.split_part(spec, F.lit("-"), F.lit(1)).try_cast("int")
    last = F.coalesce(F.nullif(F.split_part(spec, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int"), first)
    low = F.greatest(F.lit(0), first - 1)
    return F.struct(low.alias("first"), F.least(pages - 1, last - 1).alias("last"))


#: Endings that are read as text, and those of images; a text is cut at so many characters.
TEXTS = ("txt", "md", "csv", "json", "xml", "html", "htm", "log", "yaml", "yml", "toml", "ini", "cfg")
IMAGES = ("png", "jpg", "jpeg", "gif", "webp")
MOST = 200_000


def document_text(path: Column, content: Column, most: int = MOST) -> Column:
    """The text of a file by its ending: UTF-8, or Latin-1 where that fails, cut at ``most`` characters with a remark; the name of an image; null for other kinds."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    cut = F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.format_string("... (truncated, %d chars total)", F.length(text))))
    return F.when(ending.isin(*TEXTS), cut).when(ending.isin(*IMAGES), F.concat(F.lit("[image: "), F.element_at(F.split(path, "/"), -1), F.lit("]")))


def listing(paths: DataFrame, path: str, folder: str, most: int = 200, recursive: bool = False, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(entry, total): the first ``most`` names below a folder, folders with a slash, and how many there are; ignored folders are left out."""
    root = folder.rstrip("/") + "/"
    rel = paths.filter(F.col(path).startswith(root)).select(F.substring(path, len(root) + 1, 1 << 30).alias("rel"))
    parts = rel.select(F.split("rel", "/").alias("p")).filter(~F.exists("p", lambda x: x.isin(*ignored)))
    if recursive:
        ups = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.concat(F.array_join(F.slice("p", F.lit(1), n), "/"), F.when(n < F.size("p"), "/").otherwise("")))
        names = parts.select(F.explode(ups).alias("entry"))
    else:
        names = parts.select(F.concat(F.get("p", F.lit(0)), F.when(F.size("p") > 1, "/").otherwise("")).alias("entry"))
    names = names.distinct()
    total = names.agg(F.count("*").alias("total"))
    return names.orderBy("entry").limit(most).crossJoin(F.broadcast(total))
