"""Entity resolution: addresses to persons, and what a person was at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.functions.text import canonical_email, canonical_name, domain, is_internal

#: What counts as an address in running text (fixed value).
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Lines that open a signature (fixed values).
SIGN_OFFS = (
    "--", "best,", "best regards,", "regards,", "sincerely,", "thanks,", "thanks!", "thank you,", "cheers,", "many thanks,",
    "warmly,", "respectfully,", "kind regards,",
)


def parsed_address(x: Column) -> Column:
    """struct<name, email> of ``Name <a@b>`` or a bare address; null without an address."""
    inner = F.regexp_extract(x, r"^\s*(.*?)\s*<\s*([^<>\s]+@[^<>\s]+)\s*>\s*$", 2)
    bare = F.regexp_extract(x, r"^\s*([^<>\s,;]+@[^<>\s,;]+)\s*$", 1)
    email = canonical_email(F.when(inner != "", inner).otherwise(bare))
    name = canonical_name(F.regexp_extract(x, r"^\s*(.*?)\s*<", 1))
    return F.when(email != "", F.struct(F.when(inner != "", name).alias("name"), email.alias("email")))


def signature_emails(body: Column) -> Column:
    """Distinct addresses below the last sign-off line, or else in the last six lines with text among the last twenty."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]", "\n"), r"\n$", "")
    lines = F.split(text, "\n")
    at = F.aggregate(F.transform(lines, lambda x, i: F.when(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))).isin(*SIGN_OFFS), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    tail = F.filter(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 19), F.lit(20)), lambda x: F.regexp_replace(x, r"\s+", "") != "")
    tail = F.slice(tail, F.greatest(F.lit(1), F.size(tail) - 5), F.lit(6))
    region = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(tail)
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(region, "\n"), F.lit(EMAIL), F.lit(0)), lambda x: F.lower(x)))
    return F.when(body.contains("@"), found).otherwise(F.array().cast("array<string>"))  # most bodies are not cut into lines


def sightings(emails: DataFrame) -> DataFrame:
    """email_id, role, role_rank, pos, name, email, raw, observed_at: every identity that an e-mail shows, in order.

    ``emails`` has id, from_addr, to_addrs, cc_addrs, bcc_addrs, body_text, date_sent, ingested_at.
    """
    at = F.coalesce("date_sent", "ingested_at").alias("observed_at")
    roles = [("from", F.array("from_addr")), ("to", F.col("to_addrs")), ("cc", F.col("cc_addrs")), ("bcc", F.col("bcc_addrs"))]
    role_rows = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(i).alias("role_rank"), a.alias("list")) for i, (r, a) in enumerate(roles)))
    rows = emails.select(F.col("id").alias("email_id"), at, F.explode(role_rows).alias("r")).select("email_id", "observed_at", "r.role", "r.role_rank", F.posexplode("r.list").alias("pos", "raw"))
    rows = rows.withColumn("a", parsed_address(F.col("raw"))).where("a IS NOT NULL").select("email_id", "role", "role_rank", "pos", "a.name", "a.email", "raw", "observed_at")
    own = F.coalesce(parsed_address(F.col("from_addr"))["email"], F.lit(""))
    signed = emails.select(F.col("id").alias("email_id"), at, own.alias("own"), F.posexplode(signature_emails(F.col("body_text"))).alias("pos", "email")).where("email <> own")
    signed = signed.select("email_id", F.lit("signature").alias("role"), F.lit(4).alias("role_rank"), "pos", F.lit(None).cast("string").alias("name"), "email", F.col("email").alias("raw"), "observed_at")
    return rows.unionByName(signed)


def persons(seen: DataFrame, domains: tuple[str, ...] = ()) -> DataFrame:
    """One row per address: display_name (longest, then smallest; the address without any), names in first-seen order, first seen."""
    order = F.struct("email_id", "role_rank", "pos")
    names = seen.where("name IS NOT NULL").groupBy("email", "name").agg(F.min(order).alias("first"))
    names = names.groupBy("email").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("names"))
    rows = seen.groupBy("email").agg(F.min("observed_at").alias("first_seen"), F.count(F.lit(1)).alias("n_sightings")).join(names, "email", "left")
    return rows.select("email", F.coalesce("best", "email").alias("display_name"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), "first_seen", "n_sightings", is_internal(F.col("email"), domains).alias("is_internal"))


def occurrences(seen: DataFrame) -> DataFrame:
    """One row per person, role and e-mail; the first raw text wins."""
    return seen.groupBy("email", "role", "email_id").agg(F.min_by("raw", "pos").alias("raw_text"))


def affiliations(seen: DataFrame) -> DataFrame:
    """Evidence of domains; equal rows once, null sources alike."""
    return seen.select("email", F.lit("email_domain").alias("affiliation_type"), domain(F.col("email")).alias("affiliation_value"), "observed_at", F.col("email_id").alias("source_email_id")).where("affiliation_value IS NOT NULL").distinct()


class MergeError(ValueError):
    pass


def checked_merges(merges: DataFrame, people: DataFrame, key: str = "person", most: int = 64) -> DataFrame:
    """``merges`` (loser, winner) with every loser's last winner. A merge with oneself, or of unknown persons, is refused, as are circles.

    Chains are followed by doubling: each pass joins the mapping with itself, so ``most`` passes follow any chain.
    """
    m = merges.select("loser", "winner").distinct()
    if m.where("loser = winner").take(1):
        raise MergeError("a person cannot be merged with itself")
    ids = people.select(F.col(key).alias("_id")).distinct()
    if m.select(F.explode(F.array("loser", "winner")).alias("_id")).join(ids, "_id", "left_anti").take(1):
        raise MergeError("unknown person")
    if m.groupBy("loser").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise MergeError("a person can be merged into one other only")
    for _ in range(most):
        on = m.select(F.col("loser").alias("_l"), F.col("winner").alias("_w"))
        m = m.join(on, F.col("winner") == F.col("_l"), "left").select("loser", F.coalesce("_w", "winner").alias("winner"), F.col("_l").isNotNull().alias("_moved")).persist()
        if m.where("loser = winner").take(1):
            raise MergeError("merges in a circle")
        if not m.where("_moved").take(1):
            break
        m = m.drop("_moved")
    return m.select("loser", "winner")


def merged(rows: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """``key`` of each loser becomes its winner's. ``merges`` (loser, winner) holds no chains and no self-merge."""
    m = merges.where("loser <> winner")
    return rows.join(m, rows[key] == m["loser"], "left").withColumn(key, F.coalesce("winner", key)).drop("loser", "winner")


def merged_names(people: DataFrame, merges: DataFrame, key: str = "person") -> DataFrame:
    """Persons after merging: sorted union of names; the display name is the longest of them, then the smallest."""
    rows = merged(people, merges, key)
    rows = rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.min("display_name").alias("_any"))
    best = F.get(F.array_sort(F.transform("names", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"]
    return rows.select(key, F.coalesce(best, "_any").alias("display_name"), "names")


def merged_rows(rows: DataFrame, merges: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """Occurrences or affiliations after merging: of rows that become equal in ``unique`` (null-safely) the winner's own stays."""
    own = rows.withColumn("_own", F.col(key))
    moved = merged(own, merges, key)
    nth = F.row_number().over(Window.partitionBy(key, *unique).orderBy((F.col("_own") != F.col(key)).cast("int"), "_own"))
    return moved.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_own")


def merged_addresses(addresses: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Addresses (key, email, is_primary) after merging: those of losers are no longer primary."""
    rows = merged(addresses.withColumn("_own", F.col(key)), merges, key)
    return rows.withColumn("is_primary", F.col("is_primary") & (F.col("_own") == F.col(key))).drop("_own")


def internal_at(people: DataFrame, facts: DataFrame, when: str, domains: tuple[str, ...] | None, key: str = "person") -> DataFrame:
    """``people`` with internal_then: was the last domain observed up to ``when`` one of ``domains``.

    Of equal times the fact with the larger id counts; null without any. Without rules, the flag ``is_internal`` of those that were seen.
    """
    seen = facts.where((F.col("affiliation_type") == "email_domain") & (F.col("observed_at") <= F.lit(when)))
    last = seen.groupBy(key).agg(F.max_by("affiliation_value", F.struct("observed_at", "id")).alias("_domain"))
    rows = people.join(last, key, "left")
    rule = F.col("is_internal") if domains is None else is_internal(F.concat(F.lit("x@"), F.col("_domain")), domains)
    return rows.withColumn("internal_then", F.when(F.col("_domain").isNotNull(), rule)).drop("_domain")


def history(facts: DataFrame, who=None, kind: str | None = None, key: str = "person") -> DataFrame:
    """Affiliations in the order of their times, numbered for each person (``nth``, from 1); of one person, if ``who`` is given."""
    rows = facts if who is None else facts.where(F.col(key) == who)
    rows = rows if kind is None else rows.where(F.col("affiliation_type") == kind)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("observed_at", "id")))


def listed(people: DataFrame, addresses: DataFrame, occurred: DataFrame, *, is_internal=None, email_domain: str | None = None, name_contains: str | None = None, key: str = "person") -> DataFrame:
    """Persons with primary_email and occurrences, filtered; in order: ``most_seen_first``."""
    rows = people
    if is_internal is not None:
        rows = rows.where(F.col("is_internal") == F.lit(is_internal))
    if name_contains is not None:
        rows = rows.where(F.lower("display_name").contains(name_contains.lower()))
    if email_domain is not None:
        rows = rows.join(addresses.where(F.lower("email").endswith("@" + email_domain.lower())), key, "left_semi")
    first = addresses.where("is_primary").groupBy(key).agg(F.min("email").alias("primary_email"))
    n = occurred.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
    rows = rows.join(first, key, "left").join(n, key, "left")
    return rows.select(key, "display_name", "is_internal", "primary_email", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


def most_seen_first(key: str = "person") -> list:
    return [F.desc("occurrences"), "display_name", key]


def details(people: DataFrame, addresses: DataFrame, occurred: DataFrame, key: str = "person") -> DataFrame:
    """Persons with their addresses (primary first) and a map of occurrences by role."""
    mails = F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("later"), "email", "is_primary", "first_seen")))
    a = addresses.groupBy(key).agg(F.transform(mails, lambda x: F.struct(x["email"], x["is_primary"], x["first_seen"])).alias("emails"))
    o = occurred.groupBy(key, "role").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("occurrences_by_type"))
    return people.join(a, key, "left").join(o, key, "left")


def addresses(seen: DataFrame) -> DataFrame:
    """person, email, is_primary, first_seen. Before any merge a person is one address, which is its key."""
    return seen.groupBy("email").agg(F.min("observed_at").alias("first_seen")).select(F.col("email").alias("person"), "email", F.lit(True).alias("is_primary"), "first_seen")


def renamed(people: DataFrame, key: str, who: str, display: str, note: str | None = None) -> DataFrame:
    if not display.strip():
        raise ValueError("a display name may not be empty")
    hit = F.col(key) == who
    rows = people.withColumn("names", F.when(hit, F.array_union("names", F.array(F.lit(display)))).otherwise(F.col("names"))).withColumn("display_name", F.when(hit, F.lit(display)).otherwise(F.col("display_name")))
    return rows if note is None else rows.withColumn("notes", F.when(hit, F.lit(note)).otherwise(F.col("notes")))


def as_of(probes: DataFrame, facts: DataFrame, key: list[str], when: str, value: str, tie: str) -> DataFrame:
    """``probes`` with the latest ``value`` of ``facts`` (key, when, value, tie) at or before their own ``when``.

    A union and one window over the key: facts sort before probes of the same time, and the last one seen is carried on.
    """
    p = probes.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(facts.schema[value].dataType).alias("_value"), F.lit(None).cast(facts.schema[tie].dataType).alias("_tie"))
    f = facts.select(*key, F.col(when), F.lit(0).alias("_kind"), F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    w = Window.partitionBy(*key).orderBy(when, "_kind", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(f, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_kind = 1").drop("_kind", "_value", "_tie")


def classified(facts: DataFrame, at: str, key: list[str], when: str) -> DataFrame:
    """For each key the facts at the latest time up to ``at``; ties all stay."""
    rows = facts.where(F.col(when) <= F.lit(at))
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy(F.desc(when)))).where("_r = 1").drop("_r")


def recent_failures(attempts: DataFrame, minutes: int, user: str = "user_id", at: str = "ts") -> DataFrame:
    """``attempts`` with n_recent: how many of the user's fall into the window that ends with each."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(seconds).rangeBetween(-minutes * 60_000_000, 0)
    return attempts.withColumn("n_recent", F.count(F.lit(1)).over(w))
