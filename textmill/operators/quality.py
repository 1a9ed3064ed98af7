"""The quality waterfall: ordered rules on book metadata, the first that fails names the rejection.

Every rule is a built-in expression that is never null, so that a missing value means what the rule says it means.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import parse_year
from textmill.operators.dedup import claim_dedup


@dataclass(frozen=True)
class Profile:
    """Thresholds of the waterfall."""

    name: str = "default"
    language: str = "eng"
    min_share: float = 0.90
    reject_date_types: bool = True
    year_max: int = 1930
    min_ocr: float = 90
    max_disagreement: float = 10
    min_tokenizability: float = 95
    min_tokens: int = 500
    min_chars: int = 2000
    min_pages: int = 3
    min_sentences: int = 20
    sentence_tokens: int = 2000


#: The floors on lengths scaled to small documents.
SMALL = Profile(min_tokens=125, min_chars=500)
PROFILES = {
    "premium_strict": replace(SMALL, name="premium_strict"),
    "relaxed_premium": replace(SMALL, name="relaxed_premium", min_share=0.80, min_ocr=85, max_disagreement=15, min_tokenizability=90),
}


def language_share(distribution: Column, language: str) -> Column:
    """The share of a language: null if the lists are missing or empty or its share isn't a number, 0 if the language
    isn't listed; the first entry counts, and values above 1 are percentages."""
    pairs = F.arrays_zip(distribution["language"], distribution["proportion"])
    hit = F.filter(pairs, lambda p: p["language"] == language)
    value = F.get(hit, F.lit(0))["proportion"].try_cast("double")
    empty = distribution.isNull() | (F.coalesce(F.size(distribution["language"]), F.lit(0)) <= 0) | (F.coalesce(F.size(distribution["proportion"]), F.lit(0)) <= 0)
    return F.when(empty, None).when(F.size(hit) == 0, 0.0).when(value > 1, value / 100).otherwise(value)


def date_type_invalid(kind: Column) -> Column:
    low = F.lower(F.trim(kind))
    return F.coalesce(low.contains("continuing") | low.contains("no attempt") | F.substring(low, 1, 1).isin("c", "d", "n", "|"), F.lit(False))


def year_of(date1: Column, date2: Column) -> Column:
    return F.coalesce(parse_year(date1), parse_year(date2))


def derived(books: DataFrame, profile: Profile) -> DataFrame:
    """books with what the rules compare: share, year, year_source, the casts of the scores, disagreement."""
    share = language_share(F.col("distribution"), profile.language) if "distribution" in books.columns else F.col("share")
    df = books.withColumns({
        "share": share,
        "year": year_of(F.col("date1"), F.col("date2")),
        "year_source": F.when(parse_year(F.col("date1")).isNotNull(), "date1").when(parse_year(F.col("date2")).isNotNull(), "date2"),
        "ocr_a": F.col("ocr_src").try_cast("double"),
        "ocr_b": F.col("ocr_gen").try_cast("double"),
    })
    return df.withColumn("disagreement", F.abs(F.col("ocr_a") - F.col("ocr_b")))


def reject_reason(p: Profile) -> Column:
    """The first failing rule of derived rows, null if all pass."""
    c = F.col
    under = lambda name, least: c(name).isNull() | (c(name) < least)
    rules = [
        (~c("language").eqNullSafe(p.language), "language"),
        (c("share").isNull(), "language_distribution_missing"),
        (c("share") < p.min_share, "language_low_english_proportion"),
        *([(date_type_invalid(c("date_type")), "date_type_invalid")] if p.reject_date_types else []),
        (c("year").isNull(), "year_unparseable"),
        (c("year") >= p.year_max, "year_too_recent"),
        (c("ocr_a").isNull() | c("ocr_b").isNull(), "ocr_missing"),
        ((c("ocr_a") < p.min_ocr) | (c("ocr_b") < p.min_ocr), "ocr_low"),
        (c("disagreement") > p.max_disagreement, "ocr_disagree"),
        (c("tokenizability").isNull(), "tokenizability_missing"),
        (c("tokenizability") < p.min_tokenizability, "tokenizability_low"),
        (under("tokens", p.min_tokens), "too_few_tokens"),
        (under("chars", p.min_chars), "too_few_chars"),
        (under("pages", p.min_pages), "too_few_pages"),
        (c("sentences").isNull() | ((c("sentences") < p.min_sentences) & (c("tokens") < p.sentence_tokens)), "too_few_sentences"),
        (F.coalesce(c("text"), F.lit("")) == "", "empty_text"),
        (F.coalesce(c("barcode"), F.lit("")) == "", "no_barcode"),
    ]
    return F.coalesce(*(F.when(rule, name) for rule, name in rules))


def legacy_reason(year_max: int = 1930, min_ocr: float = 85, max_disagreement: float = 15) -> Column:
    """The older rules; their bounds reject what equals them."""
    c = F.col
    return F.coalesce(
        F.when(~c("language").eqNullSafe("eng"), "language"),
        F.when(c("year").isNull(), "year_unparseable"),
        F.when(c("year") >= year_max, "year_too_recent"),
        F.when(c("ocr_a").isNull() | c("ocr_b").isNull(), "ocr_missing"),
        F.when((c("ocr_a") <= min_ocr) | (c("ocr_b") <= min_ocr), "ocr_low"),
        F.when(c("disagreement") >= max_disagreement, "ocr_disagree"),
    )


def classified(books: DataFrame, profile: Profile = SMALL) -> DataFrame:
    return derived(books, profile).withColumn("reject_reason", reject_reason(profile))


def rejections(rows: DataFrame) -> DataFrame:
    """Documents by outcome."""
    return rows.groupBy(F.coalesce("reject_reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


def profile_verdicts(books: DataFrame, profiles: dict[str, Profile], *, order: str = "doc_id", key: str = "barcode", duplicates: str | None = None) -> DataFrame:
    """A row for each book and profile (and legacy) with its reason, null if it passes.  Of the rows that pass a
    profile, those whose key an earlier one has claimed are a `duplicate`; rejected rows claim nothing."""
    rows = derived(books, next(iter(profiles.values())))
    lists = F.col(duplicates) if duplicates else F.lit(None).cast("array<string>")
    verdict = F.array(*(F.struct(F.lit(n).alias("profile"), reject_reason(p).alias("reason")) for n, p in profiles.items()), F.struct(F.lit("legacy").alias("profile"), legacy_reason().alias("reason")))
    per = rows.select(F.col(order).alias("order"), F.col(key).alias("key"), lists.alias("lists"), "tokens", "pages", "topic", "year", F.explode(verdict).alias("v")).select("*", "v.profile", "v.reason").drop("v")
    tagged = lambda c: F.concat("profile", F.lit(":"), c)
    passing = per.where("reason IS NULL").select(F.struct("order", "profile").alias("at"), tagged(F.col("key")).alias("key"), F.transform("lists", tagged).alias("lists"))
    claimed = claim_dedup(passing, order="at", key="key", duplicates="lists").where("is_duplicate").select("at.order", "at.profile", F.lit("duplicate").alias("claimed"))
    return per.join(claimed, ["order", "profile"], "left").withColumn("reason", F.coalesce("reason", "claimed")).drop("claimed")


def profile_counts(verdicts: DataFrame) -> DataFrame:
    """Per profile: rows by rejection, and passing rows by topic and by decade, as (profile, kind, value, n)."""
    ok = F.col("reason").isNull()
    topic = F.when(F.coalesce("topic", F.lit("")) == "", "UNKNOWN").otherwise(F.col("topic"))
    decade = (F.floor(F.col("year") / 10) * 10).cast("string")
    kinds = F.when(~ok, F.array(F.struct(F.lit("rejection").alias("kind"), F.col("reason").alias("value")))).otherwise(F.array(F.struct(F.lit("topic").alias("kind"), topic.alias("value")), F.struct(F.lit("decade").alias("kind"), decade.alias("value"))))
    return verdicts.select("profile", F.explode(kinds).alias("k")).where("k.value IS NOT NULL").groupBy("profile", "k.kind", "k.value").agg(F.count("*").alias("n"))


def compare_profiles(books: DataFrame, profiles: dict[str, Profile], **claims: str) -> DataFrame:
    """Per profile: rows passing that are no duplicates, their tokens and pages."""
    ok = F.col("reason").isNull()
    return profile_verdicts(books, profiles, **claims).groupBy("profile").agg(F.sum(ok.cast("long")).alias("n_passed"), F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.when(ok, F.col("pages")).otherwise(0)).alias("pages"))


def joined_pages(pages: Column) -> Column:
    """Pages parted by a blank line; empty and missing ones are dropped."""
    return F.array_join(F.filter(pages, lambda p: p != ""), "\n\n")
