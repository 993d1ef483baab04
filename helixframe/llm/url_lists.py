"""URL filters with dated lists: which entries were active when a page was fetched.

List entries (pattern, action, listed_on) become validity intervals: an entry
holds from its day until the next entry of its pattern.  Captures are reduced
to distinct (host, day) pairs and each host is asked for with all its parent
domains.  The as-of join puts a pattern's intervals and the distinct days it is
asked for on one time line and takes the last interval that began, so its rows
are their sum, never their product; the longest pattern decides.  The verdicts
then meet the captures again.

All steps are DataFrame functions.  A pattern has at most one interval and one
question a day on its time line, however many captures it has; the joins after
that have one row a key on one side, and Spark can split the other.

A host is what stands between the scheme and the path without user, password,
port and closing dots, in lower case; an address has no parent domains.  Blanks
around a url don't count, and the scheme, or the scheme and its slashes, may be
left out before a name with a dot.

Defined results: a null or unreadable url, or a null day, gets verdict
``none``; of entries of one pattern and day the last in (action) order holds;
entries with a null pattern or day are ignored; ``remove`` ends an entry;
repeated captures each give a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: F.Column) -> F.Column:
    """Lower-case host, null if there is none."""
    plain = F.lower(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    marked = F.regexp_extract(plain, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#\\\\]*)", 1)
    bare = F.regexp_extract(plain, r"^([^/?#\\\\:@\s]+\.[^/?#\\\\:@\s]+(?::[0-9]*)?)(?:[/?#\\\\]|$)", 1)
    authority = F.when(plain.rlike("^(?:[a-z][a-z0-9+.-]*:)?//"), marked).otherwise(bare)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def with_parents(host: F.Column) -> F.Column:
    """The host and each parent domain of two labels or more; an address alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.rlike(r"^(\[.*|[0-9]+(\.[0-9]+){3})$"), F.array(host)).otherwise(parents)


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to): half-open intervals, the last one open (null)."""
    rows = entries.select(F.lower("pattern").alias("pattern"), "action", F.col("listed_on").cast("date").alias("valid_from"))
    rows = rows.filter("pattern IS NOT NULL AND valid_from IS NOT NULL")
    rows = rows.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))  # one entry a pattern and day
    following = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return rows.withColumn("valid_to", following).filter("action <> 'remove'").select("pattern", "action", "valid_from", "valid_to")


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """(pattern, fetched_on, action, valid_from) of the interval that holds on each distinct pattern and day, if any."""
    span = F.struct("action", "valid_from", "valid_to").alias("span")
    begun = spans.select("pattern", F.col("valid_from").alias("day"), F.lit(0).alias("asks"), span)
    days = asked.select("pattern", F.col("fetched_on").alias("day"), F.lit(1).alias("asks"), F.lit(None).cast(begun.schema["span"].dataType).alias("span"))
    so_far = Window.partitionBy("pattern").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    line = begun.unionByName(days).withColumn("span", F.last("span", ignorenulls=True).over(so_far)).filter("asks = 1")
    holds = line.filter("span IS NOT NULL AND (span.valid_to IS NULL OR day < span.valid_to)")
    return holds.select("pattern", F.col("day").alias("fetched_on"), "span.action", "span.valid_from")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """page_id, host, fetched_on, verdict (block, allow, none), pattern and since of each capture."""
    pages = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("fetched_on"))
    asked = pages.filter("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    keys = asked.select("host", "fetched_on", F.explode(with_parents(F.col("host"))).alias("pattern"))
    hits = keys.join(as_of(keys.select("pattern", "fetched_on").distinct(), validity(entries)), ["pattern", "fetched_on"])
    longest = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "action", "valid_from")).alias("best")
    verdicts = hits.groupBy("host", "fetched_on").agg(longest)
    joined = pages.join(verdicts, ["host", "fetched_on"], "left")
    return joined.select(
        "page_id", "host", "fetched_on", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("since")
    )
