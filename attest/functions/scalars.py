"""Column functions: hashes, codes, labels, paths and the status predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the root agent and key, and for the list of all types.
ROOT = "$"
NANOPUB = "https://w3id.org/np/"
CODE = r"RA[A-Za-z0-9\-_]{43}"

# The states of accounts, lists and endorsements, and what has been loaded of a key in each.
STATUSES = (
    "toRetrieve", "seen", "discarded", "retrieved", "visited", "expanded", "skipped", "encountered",
    "loading", "toLoad", "loaded", "processed", "aggregated", "approved", "contested", "capped",
)
UNLOADED = ("seen", "skipped")
CORE_LOADED = ("visited", "expanded", "processed", "aggregated", "approved", "contested", "toLoad", "loaded")
FULLY_LOADED = ("loaded",)


def hash_of(c: Column) -> Column:
    return F.sha2(c, 256)


def digest(*columns: str) -> Column:
    """16 bytes that stand for the values of these columns of text, null or not."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def type_hash(c: Column) -> Column:
    """Hash of a type URI; the list of all types keeps its sign."""
    return F.when(c == ROOT, c).otherwise(hash_of(c))


def artifact_code(uri: Column) -> Column:
    """The last artifact code at a URI's end; null if there is none."""
    found = F.regexp_extract(uri, f"({CODE})$", 1)
    return F.when(found != "", found)


def is_artifact_code(c: Column) -> Column:
    return c.rlike(f"^{CODE}$")


def agent_label(agent: Column) -> Column:
    """Short display form of an agent id; null and blank give null."""
    short = F.regexp_replace(agent, "^https://orcid\\.org/", "orcid:")
    label = F.when(F.length(short) > 55, F.concat(F.substring(short, 1, 50), F.lit("..."))).otherwise(short)
    return F.when(F.trim(agent) != "", label)


def short_label(c: Column) -> Column:
    return F.substring(c, 1, 10)


def path_text(path: Column, kind: Column) -> Column:
    """A path for reading: steps joined by ``>``, an extended path's last one by ``~``."""
    plain = F.replace(path, F.lit(" "), F.lit(" > "))
    return F.when(kind == "extended", F.regexp_replace(plain, " > ([^ ]*)$", " ~ $1")).otherwise(plain)


def path_elements(path: Column) -> Column:
    return F.split(path, " ")


def path_intermediates(path: Column) -> Column:
    """The accounts between the root and the path's own account."""
    el = path_elements(path)
    return F.slice(el, 2, F.greatest(F.size(el) - 2, F.lit(0)))


def path_sorthash(setting: Column, path: Column) -> Column:
    """A pseudo-random order of paths that differs between settings."""
    return F.sha2(F.concat_ws(" ", setting, path), 256)


def quota_from_ratio(ratio: Column, total: float = 1e9, low: int = 1_000, high: int = 100_000) -> Column:
    return F.greatest(F.least(F.floor(ratio * F.lit(float(total))), F.lit(high)), F.lit(low)).cast("int")


def exact_sum(c: Column) -> Column:
    """The sum of doubles between -1 and 1 or so in whatever order, as an aggregate: their parts down to 2**-62 and 2**-124 are summed as integers."""
    scale = F.lit(float(1 << 62))
    high = F.floor(c * scale)
    low = F.floor((c * scale - high) * scale)
    part = lambda x: F.sum(x.cast("decimal(38,0)")).cast("double")
    return part(high) / scale + part(low) / scale / scale


def nanopub_uri(full_id: Column, code: Column) -> Column:
    return F.coalesce(full_id, F.concat(F.lit(NANOPUB), code))


def url_encode(c: Column) -> Column:
    return F.url_encode(F.coalesce(c, F.lit("")))


def trim_fraction(c: Column) -> Column:
    """A timestamp's text without fractions of a second."""
    return F.regexp_replace(c, r"\.\d+", "")


def ratio_text(c: Column) -> Column:
    return F.format_string("%.8f", c)


def is_unloaded(status: Column) -> Column:
    return status.isin(*UNLOADED)


def is_core_loaded(status: Column) -> Column:
    return status.isin(*CORE_LOADED)


def is_fully_loaded(status: Column) -> Column:
    return status.isin(*FULLY_LOADED)


def checked_status(status: Column) -> Column:
    """The status itself; an error for null or an unknown one."""
    return F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))))


def xor_words(np_id: Column) -> list[Column]:
    """The eight 32-bit words of a publication's hash, whose running XOR is a list's checksum."""
    h = hash_of(np_id)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]


def words_hex(words: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [F.lower(F.lpad(F.hex(w), 8, "0")) for w in words])


def hex_words(checksum: Column) -> list[Column]:
    return [F.conv(F.substring(checksum, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
