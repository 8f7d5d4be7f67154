"""Labels for clusters, domains, topics and subtopics."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.names import entries
from grantloom.functions.wording import (
    GENERIC_TERMS,
    lowered_terms,
    ngrams,
    plain_words,
    titled,
    words_in,
)
from grantloom.operators.facets import attached
from grantloom.operators.ranking import first_rows
from grantloom.plans.clusters import lead_value
from grantloom.plans.terms import computed_once, group_term_counts, ranked_terms, term_lists
from grantloom.session import settled

# Domain categories by keyword in the joined top terms, in order of precedence.
DOMAIN_KEYWORDS = (
    ("In Vivo & Translational", "xenograft|wound|obesity|in vivo"),
    ("Molecular & Cell Biology", "laboratory mouse|gene expression|protein structure"),
    ("Research Infrastructure", "program|faculty|university|training"),
    ("Biomedical Imaging", "imaging|tomography|x-ray"),
    ("Clinical & Behavioral", "intervention|adolescent|behavioral"),
)
OTHER_CATEGORY = "Cellular Mechanisms"
DOMAIN_KEYWORDS_LONG = (
    ("In Vivo and Translational", "xenograft|in vivo|wound|obesity"),
    ("Molecular and Cell Biology", "laboratory mouse|gene expression|protein structure"),
    ("Research Infrastructure and Training", "program|faculty|university|training"),
    ("Biomedical Imaging and Analysis", "imaging|tomography|x-ray"),
    ("Epidemiology and Global Health", "world health|global|epidemiology"),
)
OTHER_CATEGORY_LONG = "Cellular and Molecular Mechanisms"
# Labels by size when no term is left.
SIZE_LABELS = ((2000, "Major Focus"), (1500, "Primary Research"), (1000, "Key Area"))
SMALL_LABEL = "Specialized"
NO_CATEGORY = "General Research"


def term_labels(points: DataFrame, group: str = "cluster", rows_per_group: int | None = None) -> DataFrame:
    """Top three terms joined by `` / `` and the top five as a list.

    All rows of a cluster are counted; ``rows_per_group`` restricts the count to the first rows by id.
    """
    rows = points
    if rows_per_group:
        rows = first_rows(points, [group], [F.col("application_id")], rows_per_group)
    terms = F.filter(lowered_terms(F.col("terms")), lambda term: F.length(term) > 3)
    lists = term_lists(ranked_terms(group_term_counts(rows, group, terms), group, 20), group)
    label = F.when(F.size("terms") >= 3, F.array_join(F.slice("terms", 1, 3), " / ")).otherwise(
        F.concat(F.lit("Topic "), F.col(group))
    )
    named = attached(points.select(group).distinct(), lists, [group])
    return named.select(
        group, label.alias("label"), F.coalesce(F.array_join(F.slice("terms", 1, 5), "; "), F.lit("")).alias("top_terms")
    )


def title_words(title: Column) -> Column:
    """Words of a title without stop words."""
    stops = words_in(StopWordsRemover.loadDefaultStopWords("english"))
    return F.filter(
        F.split(plain_words(title), " "), lambda word: (F.length(word) >= 2) & ~F.array_contains(stops, word)
    )


def title_labels(points: DataFrame, group: str = "cluster") -> DataFrame:
    """Five most frequent words and bigrams of the titles; the label is the first three in
    alphabetical order."""
    # Equal titles of a group are cut into words once.
    titles = points.groupBy(group, "title").agg(F.count(F.lit(1)).alias("copies"))
    words = computed_once(titles, [group, "copies"], "words", title_words(F.col("title")))
    counts = words.select(group, "copies", F.explode(ngrams(F.col("words"), 2)).alias("term")).groupBy(group, "term").agg(
        F.sum("copies").alias("n")
    )
    ranked = ranked_terms(counts, group, 5)
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return attached(points.select(group).distinct(), lists, [group]).select(
        group,
        F.coalesce(titled(F.array_join(F.slice("terms", 1, 3), " & ")), F.concat(F.lit("Cluster "), F.col(group))).alias("label"),
        F.coalesce(F.array_join("terms", ", "), F.lit("")).alias("keywords"),
    )


def category_ranks(points: DataFrame, group: str, limit: int) -> DataFrame:
    copies = "copies" if "copies" in points.columns else None
    return ranked_terms(group_term_counts(points, group, entries(F.col("categories")), copies), group, limit)


def category_lists(points: DataFrame, group: str, limit: int) -> DataFrame:
    lists = term_lists(category_ranks(points, group, limit), group)
    groups = points.select(group).distinct()
    return attached(groups, lists, [group])


def domain_category_labels(points: DataFrame) -> DataFrame:
    """Domain label from its two most frequent categories."""
    first, second = F.get("terms", 0), F.get("terms", 1)
    label = (
        F.when(second.isNotNull(), F.concat_ws(" & ", F.substring(first, 1, 25), F.substring(second, 1, 25)))
        .when(first.isNotNull(), F.substring(first, 1, 50))
        .otherwise(NO_CATEGORY)
    )
    return category_lists(points, "domain", 2).select("domain", label.alias("domain_label"))


def hierarchy_labels(points: DataFrame) -> DataFrame:
    """Labels of all three levels built from categories: ``parent > category``.

    All levels read one roll-up, so the points, and the tables joined to them, are read once.
    """
    points = settled(points.groupBy("domain", "topic", "subtopic", "categories").agg(F.count(F.lit(1)).alias("copies")))
    tree = points.select("domain", "topic", "subtopic").distinct()

    def child(level: str, parent: Column, size: int) -> Column:
        bare = F.concat(F.lit(f"{level.capitalize()} "), F.col(level))
        return F.concat(parent, F.lit(" > "), F.coalesce(F.substring(F.get("terms", 0), 1, size), bare))

    rows = tree.join(domain_category_labels(points), "domain")
    rows = rows.join(category_lists(points, "topic", 1), "topic")
    rows = rows.withColumn("topic_label", child("topic", F.substring("domain_label", 1, 20), 40)).drop("terms")
    rows = rows.join(category_lists(points, "subtopic", 1), "subtopic")
    parent = F.concat(F.substring("topic_label", 1, 30), F.lit("..."))
    return rows.withColumn("subtopic_label", child("subtopic", parent, 30)).drop("terms")


def unit_category_labels(points: DataFrame, group: str = "cluster") -> DataFrame:
    """``unit: category`` with long categories cut to 32 characters."""
    top = F.get("terms", 0)
    short = F.when(F.length(top) > 35, F.concat(F.substring(top, 1, 32), F.lit("..."))).otherwise(top)
    leads = lead_value(points, group, "ic", "lead")
    return category_lists(points, group, 1).join(leads, group, "left").select(
        group,
        F.concat(F.coalesce("lead", F.lit("Mixed")), F.lit(": "), F.coalesce(short, F.lit(NO_CATEGORY))).alias("label"),
    )


def three_category_labels(points: DataFrame, group: str = "cluster") -> DataFrame:
    listed = F.array_join("terms", " | ")
    label = F.when(F.size("terms") > 0, listed).otherwise(F.concat(F.lit("Topic "), F.col(group)))
    return category_lists(points, group, 3).select(group, label.alias("label"))


def inherited_term_counts(points: DataFrame, level: str, terms_per_cluster: int = 5) -> DataFrame:
    """Terms of each group, inherited from the flat clusters its points belong to.

    Points are counted per (group, cluster) first; the leading terms of a cluster then count once per
    point, so no point is joined to its terms.
    """
    terms = lowered_terms(F.col("terms"))
    cluster_terms = ranked_terms(group_term_counts(points, "cluster", terms), "cluster", terms_per_cluster)
    members = points.groupBy(level, "cluster").agg(F.count(F.lit(1)).alias("members"))
    return members.join(cluster_terms.select("cluster", "term"), "cluster").groupBy(level, "term").agg(
        F.sum("members").alias("n")
    )


def specific_labels(
    points: DataFrame, level: str, parents: DataFrame, window: int = 15, words: int = 2, joiner: str = " / ",
    generic=GENERIC_TERMS, longest: int | None = 50,
) -> DataFrame:
    """Leading non-generic terms, any leading terms if all are generic, else the parent's label.

    ``parents`` has (level, parent_label).
    """
    lists = term_lists(ranked_terms(inherited_term_counts(points, level), level, window), level)
    generics = words_in(generic)
    specific = F.filter("terms", lambda term: ~F.array_contains(generics, F.lower(term)))
    chosen = F.when(F.size(specific) > 0, specific).otherwise(F.col("terms"))
    text = titled(F.array_join(F.slice(chosen, 1, words), joiner))
    if longest:
        text = F.substring(text, 1, longest)
    return parents.join(lists, level, "left").select(
        level, F.when(F.size("terms") > 0, text).otherwise(F.col("parent_label")).alias("label")
    )


def domain_categories(points: DataFrame, terms: int = 10, rules=DOMAIN_KEYWORDS, other: str = OTHER_CATEGORY) -> DataFrame:
    """Domain category by the first keyword rule that its joined leading terms satisfy."""
    lists = term_lists(ranked_terms(inherited_term_counts(points, "domain"), "domain", terms), "domain")
    joined = F.lower(F.array_join("terms", "; "))
    branch = F
    for name, pattern in rules:
        branch = branch.when(joined.rlike(pattern), name)
    return lists.select("domain", branch.otherwise(other).alias("category"))


def domain_categories_long(points: DataFrame) -> DataFrame:
    return domain_categories(points, 8, DOMAIN_KEYWORDS_LONG, OTHER_CATEGORY_LONG)


def distinctive_labels(points: DataFrame, level: str = "subtopic", parent: str = "topic") -> DataFrame:
    """Terms in a group's ten leading terms that no sibling has among its own; the most frequent term
    if there is none; a size band if there is no term at all."""
    sizes = points.groupBy(parent, level).agg(F.count(F.lit(1)).alias("size"))
    counts = inherited_term_counts(points, level, 8)
    ranked = ranked_terms(counts, level, 10).join(sizes.select(parent, level), level)
    holders = F.count(F.lit(1)).over(Window.partitionBy(parent, "term"))
    cell = F.struct("place", "term")
    lists = ranked.withColumn("holders", holders).groupBy(level).agg(
        F.array_sort(F.collect_list(F.when(F.col("holders") == 1, cell))).alias("own"),
        F.array_sort(F.collect_list(cell)).alias("all"),
    )
    pick = F.when(F.size("own") > 0, F.slice("own", 1, 2)).otherwise(F.slice("all", 1, 1))
    text = F.array_join(F.transform(pick, lambda cell: cell["term"]), " & ")
    band = F
    for bound, name in SIZE_LABELS:
        band = band.when(F.col("size") > bound, name)
    joined = sizes.join(lists, level, "left")
    return joined.select(
        level, parent, "size",
        titled(F.when(F.size("all") > 0, text).otherwise(band.otherwise(SMALL_LABEL))).alias("label"),
    )


def inherited_categories_as_parents(points: DataFrame, level: str) -> DataFrame:
    """(level, parent_label) with the domain category as the fallback label."""
    categories = domain_categories(points)
    return points.select("domain", level).distinct().join(categories, "domain").select(
        level, F.col("category").alias("parent_label")
    )
