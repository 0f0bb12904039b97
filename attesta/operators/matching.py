"""Entity matching: blocking, signals and the verdict ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.identifiers import normalize_id
from attesta.functions.names import host_of, name_similarity, normalize_name, registrable_domain, similarity_of_normal
from attesta.functions.text import guessed_name, subject_ids


def blocked_pairs(targets: DataFrame, candidates: DataFrame, target_key: str, target_name: str, candidate_key: str, candidate_name: str) -> DataFrame:
    """Pairs that share a word of their normal names: (target_key, candidate_key, similarity).

    An equality join on words, never a product; pairs without a common word have
    similarity 0.  Distinct normal names are compared, not their bearers: names
    that many entities share are joined and scored once.
    """
    a = targets.select(F.col(target_key), normalize_name(F.col(target_name)).alias("_a")).filter("_a <> ''")
    b = candidates.select(F.col(candidate_key), normalize_name(F.col(candidate_name)).alias("_b")).filter("_b <> ''")
    split = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("_w")
    left, right = a.select("_a").distinct().select("_a", split("_a")), b.select("_b").distinct().select("_b", split("_b"))
    names = left.join(right, "_w").select("_a", "_b").distinct().select("_a", "_b", similarity_of_normal(F.col("_a"), F.col("_b")).alias("similarity"))
    return names.join(a, "_a").join(b, "_b").select(target_key, candidate_key, "similarity")


def likely_pairs(targets: DataFrame, candidates: DataFrame, target_key: str, target_name: str, candidate_key: str, candidate_name: str, least: float = 0.7) -> DataFrame:
    """As blocked_pairs, but only pairs of a similarity of ``least`` or more (at most 0.85), without joining on common words.

    Words are ordered by how many names hold them.  Two names of that similarity
    share one of the rarer words of the first, as many as may be missing from the
    second and one more; or the second has all its words in the first, its rarest
    too.  So joins on these lose no pair, and words that most names have are in none.
    """
    a = targets.select(F.col(target_key), normalize_name(F.col(target_name)).alias("_a")).filter("_a <> ''")
    b = candidates.select(F.col(candidate_key), normalize_name(F.col(candidate_name)).alias("_b")).filter("_b <> ''")
    words = lambda df, c: df.select(c).distinct().select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("_w"))
    left, right = words(a, "_a"), words(b, "_b")
    held = left.select("_w").unionAll(right.select("_w")).groupBy("_w").agg(F.count("*").alias("_n"))

    def ranked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(name)
        rows = df.join(held, "_w").withColumns({"_at": F.row_number().over(w.orderBy("_n", "_w")), "_size": F.count("*").over(w)})
        return rows.select(name, "_w", "_at", "_size")

    left, right = ranked(left, "_a"), ranked(right, "_b")
    rare = left.filter(F.col("_at") <= F.col("_size") - F.ceil(F.col("_size") * least) + 1).select("_a", "_w").join(right.select("_b", "_w"), "_w")
    within = left.select("_a", "_w").join(right.filter("_at = 1").select("_b", "_w"), "_w")
    names = rare.select("_a", "_b").unionAll(within.select("_a", "_b")).distinct().withColumn("similarity", similarity_of_normal(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= least)
    return names.join(a, "_a").join(b, "_b").select(target_key, candidate_key, "similarity")


def verdict(similarity: Column, corroboration: Column, id_match: Column, domain_conflict: Column, foreign_id: Column) -> Column:
    """struct(verdict, score): the first rung that holds."""
    score = similarity * 2.0 + corroboration * 0.5
    rung = lambda name, value: F.struct(F.lit(name).alias("verdict"), (value if isinstance(value, Column) else F.lit(float(value))).alias("score"))
    return (
        F.when(foreign_id | domain_conflict, rung("REJECTED", -1))
        .when(id_match, rung("VERIFIED", 1))
        .when((similarity >= 0.9) & (corroboration >= 1), rung("VERIFIED", F.least(F.lit(1.0), score / 3)))
        .when((similarity >= 0.7) & (corroboration >= 1), rung("LIKELY", score / 3))
        .when((similarity >= 0.95) & (corroboration == 0), rung("AMBIGUOUS", 0.3))
        .when((similarity >= 0.4) & (similarity < 0.7) & (corroboration >= 2), rung("LIKELY", score / 3))
        .when(similarity < 0.35, rung("REJECTED", 0))
        .otherwise(rung("AMBIGUOUS", 0.2))
    )


def firewall(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may be published, and the rest with its verdict as the reason."""
    good = F.col("verdict").isin("VERIFIED", "LIKELY")
    return judged.filter(good), judged.filter(~good).withColumn("reason", F.concat(F.lit("entity verdict "), F.col("verdict")))


def domain_owners(entities: DataFrame, domain: str, key: str) -> DataFrame:
    """(domain, owners, first owner) by registrable domain; counts, not lists, so a shared host stays small."""
    return entities.groupBy(domain).agg(F.count_distinct(key).alias("owners"), F.min(key).alias("first_owner"))


def signals(pairs: DataFrame, owners: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Adds what speaks for and against a candidate being its target.

    pairs: t_org, t_name, t_website, t_municipality, t_industry and c_text, c_org,
    c_name_said, c_url, c_municipality, c_industry; owners: domain, owners (array of
    organisations).  A foreign identifier, given or labelled in the text, ends the
    comparison: no other signal is set then.
    """
    c = F.col
    domain = lambda url: F.nullif(registrable_domain(host_of(c(url)), suffixes), F.lit(""))
    said = F.nullif(F.trim(normalize_id(c("c_org"))), F.lit(""))
    rows = pairs.withColumns({"_ids": subject_ids(c("c_text")), "_said": said, "_domain": domain("c_url"), "_own": domain("t_website")}).join(owners.select(F.col("domain").alias("_domain"), F.col("owners").alias("_owners")), "_domain", "left")
    foreign = F.exists("_ids", lambda x: x != c("t_org")) | F.coalesce(c("_said") != c("t_org"), F.lit(False))
    match = ~foreign & (F.coalesce(c("_said") == c("t_org"), F.lit(False)) | F.array_contains("_ids", c("t_org")))
    set_ = lambda test: ~c("foreign_id") & F.coalesce(test, F.lit(False))
    name = F.coalesce(F.nullif(c("c_name_said"), F.lit("")), guessed_name(c("c_text"), c("t_name")))
    rows = rows.withColumns({"foreign_id": foreign, "orgnr_match": match, "name_similarity": name_similarity(c("t_name"), name)})
    rows = rows.withColumns(
        {
            "domain_match": set_(c("_domain") == c("_own")),
            "domain_conflict": set_(c("_owners").isNotNull() & ~F.array_contains("_owners", c("t_org")) & ~c("orgnr_match")),
            "municipality_match": set_((c("t_municipality") != "") & (normalize_name(c("c_municipality")) == normalize_name(c("t_municipality")))),
            "industry_match": set_((F.trim("c_industry") == F.trim("t_industry")) & (F.trim("t_industry") != "")),
        }
    )
    return rows.drop("_ids", "_said", "_domain", "_own", "_owners")


def corroboration() -> Column:
    """How many signals beside name and identifier agree."""
    return sum((F.col(x).cast("int") for x in ("domain_match", "municipality_match", "industry_match")), F.lit(0))
