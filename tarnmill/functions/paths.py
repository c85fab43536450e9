"""Keys taken from paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, base: str) -> Column:
    """``path`` without the leading ``base`` folder and slashes. Scheme and host are
    dropped first when the base folder is given without them."""
    folder = base.rstrip("/") + "/"
    located = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "") if base.startswith("/") else path
    inside = F.startswith(located, F.lit(folder))
    return F.ltrim(F.when(inside, F.substr(located, F.lit(len(folder) + 1))).otherwise(located), F.lit("/"))


def repo_of_path(relative: Column) -> Column:
    """First two segments, ``org/name``; NULL when there are fewer."""
    parts = F.split(relative, "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def repo_of_url(url: Column) -> Column:
    """Struct of the organisation and name, segments 3 and 4 of a repository URL."""
    parts = F.split(url, "/")
    return F.struct(F.get(parts, F.lit(3)).alias("org"), F.get(parts, F.lit(4)).alias("name"))


def rebased_path(relative: Column, output_dir: str) -> Column:
    return F.concat_ws("/", F.lit(output_dir.rstrip("/")), relative)


def token_file_name(relative: Column) -> Column:
    """Name of the tokenised file: full relative path with ``.txt`` as extension, so
    equal base names in different folders of one repository stay apart."""
    return F.concat(F.regexp_replace(relative, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))
