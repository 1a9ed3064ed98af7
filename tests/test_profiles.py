"""Profiles whose passing rows claim their keys."""

from collections import Counter

from pyspark.sql import functions as F

from textmill.operators import quality
from textmill.sources.tables import books


def test_profiles_drop_claimed_duplicates(spark, sf_dir):
    lists = F.array(F.concat(F.lit("B"), F.col("doc_id") + 1), F.concat(F.lit("B"), F.col("doc_id") + 2), F.concat(F.lit("B"), F.col("doc_id") + 9))
    rows = books(spark, sf_dir).withColumn("copies", lists)
    verdicts = quality.profile_verdicts(rows, quality.PROFILES, duplicates="copies")
    found = {(r["order"], r["profile"]): r["reason"] for r in verdicts.collect()}
    plain = {(r["order"], r["profile"]): r["reason"] for r in quality.profile_verdicts(rows, quality.PROFILES).collect()}
    sizes = {r["doc_id"]: (r["tokens"], r["pages"]) for r in rows.select("doc_id", "tokens", "pages").collect()}
    totals, rejected = {}, Counter()
    for profile in [*quality.PROFILES, "legacy"]:
        claimed, passed = set(), []
        for d in sorted(sizes):
            reason = plain[d, profile]
            if reason is None and f"B{d}" in claimed:
                reason = "duplicate"
            assert found[d, profile] == reason
            if reason is None:
                claimed.update(f"B{d + k}" for k in (0, 1, 2, 9))
                passed.append(d)
            else:
                rejected[profile, reason] += 1
        totals[profile] = (len(passed), sum(sizes[d][0] for d in passed), sum(sizes[d][1] for d in passed))
    assert sum(n for (_, reason), n in rejected.items() if reason == "duplicate") > 0
    got = quality.compare_profiles(rows, quality.PROFILES, duplicates="copies").collect()
    assert {r["profile"]: (r["n_passed"], r["tokens"], r["pages"]) for r in got} == totals
    counts = quality.profile_counts(verdicts).collect()
    assert {(r["profile"], r["value"]): r["n"] for r in counts if r["kind"] == "rejection"} == dict(rejected)
    assert sum(r["n"] for r in counts if r["kind"] == "topic") == sum(t[0] for t in totals.values())
