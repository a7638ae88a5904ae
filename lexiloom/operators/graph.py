"""Structural groups of an external graph: nodes, links, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.fixed import LIMITS
from .topk import per_key, top_k


def pick(obj: Column, *keys: str) -> Column:
    """The first non-empty text among the keys of a JSON text; numbers come as text, zero counts."""
    return F.coalesce(*[F.nullif(F.get_json_object(obj, f"$.{k}"), F.lit("")) for k in keys])


def usable_cohesion(value: Column) -> Column:
    """A finite number of at most a million, else null; JSON booleans and names are not numbers."""
    number = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), value.cast("double"))
    return F.when(F.abs(number) <= 1e6, number)


def provenance(source: Column, glossary_files: tuple[str, ...] = ("GLOSSARY.md",)) -> Column:
    parts = F.split(F.lower(F.coalesce(source, F.lit(""))), "/")
    tidy = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    name = F.try_element_at(tidy, F.lit(-1))
    return F.when(name.isin([g.lower() for g in glossary_files]), "glossary").when(name.rlike(r"\.(md|rst|txt|adoc)$"), "doc").otherwise("code")


def graph_tables(nodes: DataFrame, links: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, links and communities from (pos, o) elements as JSON texts; a later node of one id wins, order decides."""
    nodes = nodes.select("pos", pick(F.col("o"), "id", "name").alias("id"), F.substring(pick(F.col("o"), "label", "name", "id"), 1, LIMITS["label_chars"]).alias("label"), pick(F.col("o"), "source_file", "file", "path").alias("source_file"), pick(F.col("o"), "community").alias("community"), pick(F.col("o"), "community_name").alias("community_name"))
    nodes = nodes.where("id is not null").groupBy("id").agg(F.max_by(F.struct("label", "source_file", "community", "community_name"), "pos").alias("n")).select("id", "n.*")
    links = links.select(pick(F.col("o"), "source", "from").alias("source"), pick(F.col("o"), "target", "to").alias("target")).where("source is not null and target is not null")
    groups = groups.select("pos", pick(F.col("o"), "id").alias("id"), pick(F.col("o"), "label", "name").alias("label"), usable_cohesion(F.get_json_object("o", "$.cohesion")).alias("cohesion"), F.coalesce(F.from_json(F.get_json_object("o", "$.nodes"), "array<string>"), F.array().cast("array<string>")).alias("nodes"))
    return nodes, links, groups


def parse_graph(texts: DataFrame, col: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of whole, small documents, one a row."""
    one = lambda *names: texts.select(F.posexplode(F.coalesce(*[F.from_json(F.get_json_object(col, f"$.{n}"), "array<string>") for n in names], F.array().cast("array<string>"))).alias("pos", "o"))
    return graph_tables(one("nodes"), one("links", "edges"), one("communities"))


def label_characters(nodes: DataFrame) -> int:
    """Characters of all labels after their cut: what splitting them would cost, known before any is split."""
    return nodes.agg(F.coalesce(F.sum(F.length("label")), F.lit(0))).head()[0]


def visible_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes that don't come from a glossary."""
    seen = nodes.where(provenance(F.col("source_file")) != "glossary").select("id")
    return links.join(seen.withColumnRenamed("id", "source"), "source", "left_semi").join(seen.withColumnRenamed("id", "target"), "target", "left_semi")


def node_degrees(links: DataFrame) -> DataFrame:
    """(id, degree): both ends count, a loop twice."""
    return links.select(F.col("source").alias("id")).union(links.select("target")).groupBy("id").agg(F.count("*").alias("degree"))


def god_nodes(degrees: DataFrame, cap: int = LIMITS["god_nodes"]) -> DataFrame:
    return top_k(degrees, cap, F.desc("degree"), F.asc("id"))


def memberships(nodes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(group, id, pos): explicit lists, repeats of a member dropped, else the nodes' own attribute."""
    if groups is None:
        return nodes.where("community is not null").select(F.col("community").alias("group"), "id", F.lit(0).alias("pos"))
    rows = groups.select(F.col("id").alias("group"), "pos", F.posexplode("nodes").alias("at", "node"))
    return rows.groupBy("group", F.col("node").alias("id")).agg(F.min(F.struct("pos", "at")).alias("first")).select("group", "id", F.col("first.at").alias("pos"))


def group_labels(nodes: DataFrame) -> DataFrame:
    """(group, label, conflict): the most frequent community name, ties to the first in order."""
    votes = nodes.where("community is not null and community_name is not null").groupBy(F.col("community").alias("group"), F.col("community_name").alias("label")).agg(F.count("*").alias("votes"))
    names = votes.withColumn("names", F.count("*").over(Window.partitionBy("group")))
    return per_key(names, ["group"], 1, F.desc("votes"), F.asc("label")).select("group", "label", (F.col("names") > 1).alias("conflict"))


def label_tokens(nodes: DataFrame) -> DataFrame:
    """(id, token): each distinct label is split once."""
    labels = lexical.tokenize_distinct(nodes.select(F.col("label").alias("name")).where("label is not null").distinct())
    return nodes.join(labels, F.col("label") == F.col("name")).select("id", F.explode("tokens").alias("token")).distinct()


def member_tokens(members: DataFrame, nodes: DataFrame, cap: int = LIMITS["member_tokens"]) -> tuple[DataFrame, DataFrame]:
    """(group, token) of visible members, at most ``cap`` of a group in order of the alphabet, and (group, tokens, dropped) of the groups that have more."""
    seen = nodes.where(provenance(F.col("source_file")) != "glossary").select("id", "label")
    every = members.join(label_tokens(seen), "id").select("group", "token").distinct()
    counts = every.groupBy("group").agg(F.count("*").alias("tokens")).where(F.col("tokens") > cap)
    return per_key(every, ["group"], cap, F.asc("token")).drop("rank"), counts.withColumn("dropped", F.col("tokens") - cap)


def group_summary(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, size, code, doc): visible members by provenance."""
    seen = members.join(nodes.select("id", provenance(F.col("source_file")).alias("p")), "id").where("p != 'glossary'")
    return seen.groupBy("group").agg(F.count("*").alias("size"), F.sum((F.col("p") == "code").cast("long")).alias("code"), F.sum((F.col("p") == "doc").cast("long")).alias("doc"))


def member_samples(members: DataFrame, nodes: DataFrame, degrees: DataFrame, cap: int = LIMITS["group_members"]) -> DataFrame:
    """(group, members): the labels of each group's visible members with most links, then by label."""
    seen = members.join(nodes.where(provenance(F.col("source_file")) != "glossary").select("id", "label"), "id").join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return per_key(seen, ["group"], cap, F.desc("degree"), F.asc("label"), F.asc("id")).groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("members"))


def structure_scores(summary: DataFrame, cohesion: DataFrame, cap: int = 10) -> DataFrame:
    """size + 10 cohesion of groups of two or more."""
    rows = summary.where("size >= 2").join(cohesion, "group", "left")
    return top_k(rows.select("group", "size", F.round(F.col("size") + 10 * F.coalesce("cohesion", F.lit(0.0)), 2).alias("score")), cap, F.desc("score"), F.asc("group"))


def freshness(recorded: Column, head: Column, dirty: Column) -> Column:
    """current, stale or unverified, by the commit a graph was made at; seven or more leading digits of it will do."""
    same = (recorded == head) | ((F.length(recorded) >= 7) & head.startswith(recorded))
    return F.when(recorded.isNull() | head.isNull() | dirty.isNull(), "unverified").when(same & ~dirty, "current").otherwise("stale")


def concept_strength(group_tokens: DataFrame, group_label_tokens: DataFrame, concept_tokens: DataFrame) -> DataFrame:
    """(group, concept, strength) of groups and concepts that share a token; ``concept_tokens(concept, token, own)``: own marks the term's.

    3: the label has all of the term's tokens; 2: the label and the members have;
    1: some token of the term or of a symbol binding is shared. An equality join
    on tokens makes the candidates, counts decide.
    """
    need = concept_tokens.groupBy("concept").agg(F.count_if("own").alias("need"))
    label = group_label_tokens.select("group", "token").distinct().withColumn("named", F.lit(True))
    every = group_tokens.select("group", "token").withColumn("named", F.lit(False)).union(label).groupBy("group", "token").agg(F.max("named").alias("named"))
    met = every.join(concept_tokens, "token").groupBy("group", "concept").agg(F.count_if(F.col("own") & F.col("named")).alias("in_label"), F.count_if("own").alias("in_all")).join(need, "concept")
    strength = F.when((F.col("need") > 0) & (F.col("in_label") == F.col("need")), 3).when((F.col("need") > 0) & (F.col("in_all") == F.col("need")), 2).otherwise(1)
    return met.select("group", "concept", strength.cast("long").alias("strength"))
