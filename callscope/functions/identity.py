"""Identity of files and definitions: canonical paths and entity ids."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that Spark's JSON writer escapes otherwise than the id's canonical form.
_ODD = r"[\x0b\x0e\x0f\x1a-\x1f]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_path(path: Column) -> Column:
    """Repository-relative path with forward slashes and no ``.`` or ``..`` parts.

    Empty, absolute and drive paths, and those that leave the repository or name it
    itself, are errors when evaluated; null stays null.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (slashed == "") | F.startswith(slashed, F.lit("/")) | F.rlike(slashed, F.lit("^[A-Za-z]:"))
    kept = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    # A step up from the root is marked by null, which stays.
    up = lambda a: F.when(a.isNull() | (F.size(a) == 0), F.lit(None)).otherwise(F.slice(a, 1, F.size(a) - 1))
    parts = F.aggregate(kept, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", up(a)).when(a.isNull(), F.lit(None)).otherwise(F.concat(a, F.array(p))))
    good = F.when(~bad & parts.isNotNull() & (F.size(parts) > 0), F.array_join(parts, "/"))
    error = F.raise_error(F.concat(F.lit("not a path inside a repository: "), path))
    return F.when(path.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(good, error.cast("string")))


def is_repository_path(path: Column) -> Column:
    """Whether :func:`normalize_path` accepts the path."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (slashed == "") | F.startswith(slashed, F.lit("/")) | F.rlike(slashed, F.lit("^[A-Za-z]:"))
    kept = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(kept, F.lit(0), lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).otherwise(d + 1))
    return F.coalesce(~bad & (depth > 0), F.lit(False))


def canonical_id(fields: list[str]) -> str:
    """Entity id of the five fields, already stripped."""
    data = json.dumps(fields, ensure_ascii=False, separators=(",", ":"))
    return "fn:v1:" + hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest()


_exact_id = F.udf(lambda fields: canonical_id(list(fields)), T.StringType())


def entity_id(repository: Column, path: Column, language: Column, qualified_name: Column, discriminator: Column, normalized: bool = False) -> Column:
    """``fn:v1:`` and the SHA-256 of a compact JSON array of the stripped fields; null if one is null or blank.

    Stays in the JVM but for fields with control characters that Spark's JSON spells
    differently.
    """
    path = strip(path) if normalized else normalize_path(strip(path))
    fields = [strip(repository), path, F.lower(strip(language)), strip(qualified_name), strip(discriminator)]
    whole = F.array(*fields)
    good = ~F.exists(whole, lambda x: x.isNull() | (x == ""))
    fast = F.concat(F.lit("fn:v1:"), F.sha2(F.to_json(whole).cast("binary"), 256))
    odd = F.rlike(F.array_join(whole, ""), F.lit(_ODD))
    return F.when(F.coalesce(good, F.lit(False)), F.when(odd, _exact_id(whole)).otherwise(fast))


def signature(text: Column) -> Column:
    """White space collapsed and stripped."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def discriminator(sig: Column, occurrence: Column) -> Column:
    """``signature:<signature or unknown>;occurrence:<n>``."""
    return F.concat(F.lit("signature:"), F.coalesce(F.nullif(sig, F.lit("")), F.lit("unknown")), F.lit(";occurrence:"), occurrence.cast("string"))


def embedding_text(qualified_name: Column, path: Column) -> Column:
    """What is embedded of a function; its body is not."""
    return F.concat(F.lit("Function: "), qualified_name, F.lit("\nFile: "), path)


def repository_name(text: Column) -> Column:
    """``owner/repository`` without ``.git``; null if it is none."""
    name = F.regexp_replace(strip(text), r"\.git$", "")
    return F.when(F.rlike(name, F.lit(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")), name)


def repository_of_url(url: Column) -> Column:
    """``owner/repository`` of an https URL of the code host; null if it is none."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    path = F.regexp_replace(F.try_url_decode(F.parse_url(url, F.lit("PATH"))), r"^/+|/+$", "")
    good = (F.lower(F.parse_url(url, F.lit("PROTOCOL"))) == "https") & host.isin("github.com", "www.github.com")
    return F.when(good, repository_name(path))
