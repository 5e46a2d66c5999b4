"""Paths: parts, languages, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^./]+)$", 1))


def has_extension(path: Column, ext: str) -> Column:
    return extension(path) == ext.lower().lstrip(".")


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def relative(path: Column, root: str) -> Column:
    """``path`` below ``root``; a path elsewhere stays."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


#: Language: its extensions.
LANGUAGES = {
    "javascript": "js mjs", "jsx": "jsx", "typescript": "ts", "tsx": "tsx", "python": "py pyw", "java": "java", "csharp": "cs",
    "rust": "rs", "go": "go", "php": "php", "ruby": "rb", "swift": "swift", "kotlin": "kt", "scala": "scala", "cpp": "cpp cxx cc hpp",
    "c": "c h", "shell": "sh zsh fish", "bash": "bash", "powershell": "ps1", "sql": "sql", "yaml": "yaml yml", "json": "json",
    "css": "css scss sass less", "html": "html htm", "xml": "xml", "dockerfile": "dockerfile", "markdown": "md markdown", "lua": "lua",
    "perl": "pl", "r": "r", "matlab": "m", "haskell": "hs", "elixir": "ex exs", "erlang": "erl", "clojure": "clj", "dart": "dart",
    "vim": "vim", "ini": "ini cfg conf", "properties": "properties", "makefile": "makefile", "cmake": "cmake", "diff": "diff",
    "patch": "patch", "log": "log", "txt": "txt",
}

#: Category: its extensions. Every other extension is of category other.
CATEGORIES = {
    "code": "js jsx ts tsx py java c cpp cs go rb php swift kt rs",
    "markup": "html htm xml svg css scss less sass",
    "document": "txt md rtf doc docx odt pdf",
    "data": "json yaml yml toml",
    "image": "jpg jpeg png gif bmp tiff webp ico",
    "video": "mp4 avi mov wmv flv webm mkv",
    "audio": "mp3 wav ogg flac aac m4a",
    "archive": "zip rar 7z tar gz bz2",
    "spreadsheet": "xls xlsx csv ods",
    "presentation": "ppt pptx odp",
    "database": "db sqlite sql",
    "script": "sh bash bat cmd ps1",
    "font": "ttf otf woff woff2 eot",
    "config": "config conf ini env",
    "log": "log",
}


def _by_extension(table: dict[str, str]) -> dict[str, str]:
    return {e: name for name, exts in table.items() for e in exts.split()}


def language(path: Column) -> Column:
    """The language by extension (a file named like one, such as Makefile, counts), plaintext otherwise."""
    entries = _by_extension(LANGUAGES)
    ext = F.lower(F.substring_index(base_name(path), ".", -1))
    return F.coalesce(F.create_map(*(F.lit(v) for kv in entries.items() for v in kv))[ext], F.lit("plaintext"))


def categories(df: DataFrame, path: str = "file_path") -> DataFrame:
    """``df`` with category, by a broadcast join with the fixed table (about 80 rows)."""
    spark = df.sparkSession
    lookup = spark.createDataFrame(list(_by_extension(CATEGORIES).items()), "_ext string, category string")
    ext = F.lower(F.substring_index(base_name(F.col(path)), ".", -1))
    return df.withColumn("_ext", ext).join(F.broadcast(lookup), "_ext", "left").withColumn("category", F.coalesce("category", F.lit("other"))).drop("_ext")
