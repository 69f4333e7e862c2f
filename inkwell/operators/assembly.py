"""From ranked rows to evidence: references, connected chunks, citations, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import by_keys, written
from .filters import SEP, section_parts
from .search import rows_holding


def union_references(rows: DataFrame, keys: list[str], parent: str = "parent_id", step: str = "step_id", rank: str = "rank0") -> DataFrame:
    """References of a plan's steps, each once, at its first place in (step, rank) order."""
    first = Window.partitionBy(parent, *keys).orderBy(step, rank)
    kept = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(parent).orderBy(step, rank, *keys)) - 1)


def citations(items: DataFrame, chunks: DataFrame, item: str, keys: list[str], gram: int = 4) -> DataFrame:
    """item, keys of chunks whose text holds the citation, white space aside.

    A citation of several words stands in a text only with its run of `gram` words (all its words, if fewer)
    that follows its first word; runs of words are joined first, then containment is checked. The first
    and last word may be parts of longer ones, so they are left out of the run. Citations of fewer than three words
    find chunks through rows_holding. Only runs as long as a citation's are made.
    """
    norm = lambda c: F.trim(F.regexp_replace(T.text_or_empty(c), r"\s+", " "))
    own = items.select(item, norm(F.col("citation")).alias("_cite")).filter("_cite <> ''").withColumn("_words", F.split("_cite", " "))
    size = F.least(F.size("_words") - 2, F.lit(gram))
    keyed = own.withColumn("_size", size).withColumn("_run", F.array_join(F.slice("_words", 2, F.greatest(size, F.lit(1))), " "))
    rows = chunks.select(*keys, norm(F.col("content")).alias("_norm")).withColumn("_split", F.split("_norm", " "))
    long = keyed.filter("_size >= 1")
    sizes = sorted(r[0] for r in long.select("_size").distinct().collect())  # gram numbers at most
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_split") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("_split", i, n), " "))
    runs = rows.select(*keys, F.explode(F.concat(F.array().cast("array<string>"), *map(of_size, sizes))).alias("_run"))
    met = runs.join(long.select(item, "_cite", "_run"), "_run").select(item, "_cite", *keys).distinct()
    got = met.join(rows.select(*keys, "_norm"), keys).filter(F.contains("_norm", "_cite")).select(item, *keys)
    few = keyed.filter("_size < 1")
    return got.unionByName(rows_holding(rows, F.col("_norm"), few, keys, item, F.col("_cite")))


def connected(rows: DataFrame, chunks: DataFrame, scope: tuple[str, ...] = ("document_id", "revision_id")) -> DataFrame:
    """Chunks that text rows connect to in their own revision and that are not among the rows, with score 0."""
    targets = rows.filter("chunk_type = 'text'").select(*scope, F.explode(F.filter(F.transform("connect_to", lambda c: F.trim(c["target"])), lambda t: t != "")).alias("chunk_id")).distinct()
    new = targets.join(rows.select(*scope, "chunk_id").distinct(), [*scope, "chunk_id"], "left_anti")
    return chunks.join(new, [*scope, "chunk_id"]).withColumn("score", F.lit(0.0))


def referenced(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk for each reference (ref_id, document_id, chunk_id, section_path): the same section, else Root
    where the reference names the file, else the first of that id."""
    met = refs.withColumnRenamed("section_path", "_wanted").join(chunks, ["document_id", "chunk_id"], "left")
    fit = F.when(F.col("_wanted").eqNullSafe(F.col("section_path")), 0).when((F.col("section_path") == "Root") & (F.col("_wanted") == F.col("source_file_name")), 1).otherwise(2)
    w = Window.partitionBy("ref_id").orderBy(fit, "sort_order", "section_path")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_wanted")


def by_paths(selections: DataFrame, chunks: DataFrame) -> DataFrame:
    """selections(selection, document_id, path, mode) -> chunks by mode, in order of selection.

    outline and self_only take the section itself, shallow also its direct children, chunks all below it,
    assets_only, image_only and table_only the media of all below it. Prefixes of each chunk's path are joined.
    """
    parts = section_parts(F.col("section_path"))
    rows = chunks.withColumn("_depth", F.size(parts)).withColumn("_cut", F.explode(F.when(F.size(parts) == 0, F.array(F.lit("Root"))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), SEP)))))
    met = rows.join(selections.select("selection", "document_id", F.col("path").alias("_cut"), "mode"), ["document_id", "_cut"])
    far = F.col("_depth") - F.size(section_parts(F.col("_cut")))
    media = F.col("chunk_type").isin("image", "table")
    ok = (
        F.when(F.col("mode").isin("outline", "self_only"), far == 0).when(F.col("mode") == "shallow", far <= 1).when(F.col("mode") == "chunks", F.lit(True))
        .when(F.col("mode") == "assets_only", media).when(F.col("mode") == "image_only", F.col("chunk_type") == "image").when(F.col("mode") == "table_only", F.col("chunk_type") == "table").otherwise(F.lit(False))
    )
    w = Window.partitionBy("document_id", "chunk_id").orderBy("selection")
    return met.filter(ok).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_cut", "_depth")


def hydrated(selections: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Outline rows and chunk rows of selections(selection, document_id, path, mode), in order of selection.

    A path selected as outline gives one row of the section itself, title and summary as content; other modes give chunks, see by_paths. A path
    counts with its first selection.
    """
    first = selections.groupBy("document_id", "path").agg(F.min_by(F.struct("selection", "mode"), "selection").alias("_f")).select("document_id", "path", "_f.*")
    named = first.filter("mode = 'outline'").join(sections.withColumnRenamed("section_path", "path"), ["document_id", "path"])
    said = F.trim(F.coalesce("summary", F.lit("")))
    content = F.concat(F.lit("[Outline] "), F.trim("section_title"), F.when(said != "", F.concat(F.lit("\n"), said)).otherwise(F.lit("")))
    outline = named.select("document_id", F.concat_ws("_", F.lit("outline"), "document_id", "sort_order").alias("chunk_id"), F.col("path").alias("section_path"), F.lit("outline").alias("chunk_type"), content.alias("content"), "sort_order", "selection", "mode")
    rows = by_paths(first.filter("mode <> 'outline'"), chunks)
    return outline.unionByName(rows.select("document_id", "chunk_id", "section_path", "chunk_type", "content", "sort_order", "selection", "mode"))


def assembled(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Result rows without those that another row embeds; connected tables' texts follow in order; references go."""
    links = rows.select("query_id", "document_id", "chunk_id", F.explode_outer("connect_to").alias("_c")).select("query_id", "document_id", F.col("chunk_id").alias("_owner"), F.trim("_c.target").alias("chunk_id"), F.col("_c.relation").alias("_relation"))
    embedded = links.filter("_relation = 'embeds' and chunk_id <> _owner").select("query_id", "document_id", "chunk_id").distinct()
    tables = links.join(chunks.filter("chunk_type = 'table'").select("document_id", "chunk_id", "sort_order", F.col("content").alias("_text")), ["document_id", "chunk_id"])
    tables = tables.dropDuplicates(["query_id", "document_id", "_owner", "chunk_id"]).groupBy("query_id", "document_id", F.col("_owner").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", "_text"))).alias("_tables"))
    kept = rows.join(embedded, ["query_id", "document_id", "chunk_id"], "left_anti").join(tables, ["query_id", "document_id", "chunk_id"], "left")
    more = F.array_join(F.transform("_tables", lambda t: t["_text"]), "\n")
    return kept.withColumn("content", F.concat_ws("\n", T.without_refs(F.col("content")), more)).drop("_tables")


def evidence_text(rows: DataFrame) -> DataFrame:
    """Per query and document one text: a header, section headers where the section changes, then the lines."""
    w = Window.partitionBy("query_id", "document_id").orderBy("section_path", "sort_order", "chunk_id")
    head = F.when(F.col("section_path").eqNullSafe(F.lag("section_path").over(w)), "").otherwise(F.concat(F.lit("▸ "), F.col("section_path"), F.lit("\n")))
    lines = F.array_join(F.transform(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("┈ "), x)), "\n")
    parts = rows.withColumn("_n", F.row_number().over(w)).withColumn("_part", F.concat(head, lines))
    grouped = parts.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_part"))).alias("_p"), F.first("source_file_name").alias("source_file_name"))
    return grouped.select("query_id", "document_id", F.concat(F.lit("[Document] "), "source_file_name", F.lit("\n"), F.array_join(F.transform("_p", lambda x: x["_part"]), "\n")).alias("evidence"))


def with_media(rows: DataFrame) -> DataFrame:
    """Text rows whose references are replaced by the media they name (array<struct<ref, text>> media); media that
    no reference names follow at the end."""
    body = F.aggregate("media", F.col("content"), lambda a, m: F.replace(a, m["ref"], m["text"]))
    rest = F.array_join(F.transform(F.filter("media", lambda m: ~F.contains(F.col("content"), m["ref"])), lambda m: m["text"]), "\n")
    return rows.withColumn("content", F.concat_ws("\n", body, F.nullif(rest, F.lit(""))))


def within_budget(rows: DataFrame, budget: int, share: float = 0.9) -> DataFrame:
    """Drops the least useful rows (confidence, discovery, importance, larger first) until share of budget holds."""
    cost = T.token_estimate(F.col("content"))
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("discovery_score"), F.desc("importance"), "_cost", "chunk_id")
    kept = rows.withColumn("_cost", cost).withColumn("used_tokens", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.filter(F.col("used_tokens") <= int(budget * share)).drop("_cost")


def placed_assets(assets: DataFrame, present: DataFrame) -> DataFrame:
    """Assets at their owner's section, or the nearest ancestor that is present; none: at Root."""
    parts = section_parts(F.col("owner_path"))
    ups = assets.select("document_id", "chunk_id", "owner_path", F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), SEP))).alias("_d", "section_path"))
    met = ups.join(present.select("document_id", "section_path").distinct(), ["document_id", "section_path"], "left_semi")
    best = met.groupBy("document_id", "chunk_id").agg(F.max_by("section_path", "_d").alias("placed_at"))
    return assets.join(best, ["document_id", "chunk_id"], "left").withColumn("placed_at", F.coalesce("placed_at", F.lit("Root")))


def referenced_ids(rows: DataFrame) -> DataFrame:
    """Each chunk of a result tree once; Root shows as the document's file name."""
    w = Window.partitionBy("query_id", "document_id", "chunk_id").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumn("section_path", F.when(F.col("section_path") == "Root", F.col("source_file_name")).otherwise(F.col("section_path")))


def asset_owners(chunks: DataFrame) -> DataFrame:
    """Media chunks with the section of the first text chunk that connects to them; without one, their own section
    unless that is Root, which drops them."""
    owner = chunks.filter("chunk_type = 'text'").select("document_id", "section_path", "sort_order", F.explode("connect_to").alias("_c"))
    owner = owner.groupBy("document_id", F.trim("_c.target").alias("chunk_id")).agg(F.min_by("section_path", "sort_order").alias("_owner"))
    media = chunks.filter(F.col("chunk_type").isin("image", "table")).join(owner, ["document_id", "chunk_id"], "left")
    return media.withColumn("owner_path", F.coalesce(F.col("_owner"), F.when(F.col("section_path") != "Root", F.col("section_path")))).filter("owner_path is not null").drop("_owner")


def entry_documents(queries: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose section titles or paths hold the query; queries without any look into contents.

    Titles end their paths, so paths are searched, each different one once; texts are read once for a block of queries.
    """
    low = lambda c: F.lower(T.text_or_empty(F.col(c)))
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("_q")).filter("_q <> ''")
    names = F.array(low("section_path"), low("section_title"))
    named = written(sections.select("document_id", F.explode(F.array_distinct(names)).alias("_name")).distinct())
    met = rows_holding(named.select("_name").distinct(), F.col("_name"), asked, ["_name"], "query_id", F.col("_q"))
    by_title = written(named.join(met, "_name").select("query_id", "document_id", F.lit("title").alias("via")).distinct())
    rest = asked.join(by_title.select("query_id").distinct(), "query_id", "left_anti")
    by_text = rows_holding(chunks, low("content"), rest, ["document_id", "chunk_id"], "query_id", F.col("_q")).select("query_id", "document_id", F.lit("content").alias("via")).distinct()
    return by_title.unionByName(by_text)


def candidate_chunks(entries: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Of entry documents, the first k chunks in order that share a token with the query; score 2."""
    asked = queries.select("query_id", T.tokens(F.col("query"), T.STOPWORDS, distinct=True).alias("_t"))
    met = entries.join(asked, "query_id").join(chunks, "document_id").filter(F.arrays_overlap("_t", T.tokens(F.col("content"), distinct=True)))
    w = Window.partitionBy("query_id").orderBy("document_id", "sort_order", "chunk_id")
    return met.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).withColumn("score", F.lit(2.0)).drop("_t")


def ranked_candidates(discovery: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """Rows of both lists (query_id, key, discovery_score, agent_score, importance) by agent score, then discovery score,
    then place; rows without an agent score only fill up. Scores are scaled by the importance multiplier."""
    from .ranking import importance_multiplier

    both = discovery.unionByName(routed, allowMissingColumns=True).groupBy("query_id", "key").agg(F.max("agent_score").alias("agent_score"), F.max("discovery_score").alias("discovery_score"), F.max("importance").alias("importance"), F.min("place").alias("place"))
    both = importance_multiplier(both, ["query_id"], "importance")
    both = both.withColumn("_fill", F.col("agent_score").isNull()).withColumn("agent_score", F.round(F.coalesce("agent_score", F.lit(0.0)) * F.col("multiplier"), 6)).withColumn("discovery_score", F.round(F.coalesce("discovery_score", F.lit(0.0)) * F.col("multiplier"), 6))
    w = Window.partitionBy("query_id").orderBy("_fill", F.desc("agent_score"), F.desc("discovery_score"), "place", "key")
    return both.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k)


def context(rows: DataFrame, budget: int) -> DataFrame:
    """Chunks of distinct texts in rank order while their estimated tokens stay within the budget."""
    w = Window.partitionBy("query_id", F.sha2("content", 256)).orderBy("rank0")
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    used = F.sum(T.token_estimate(F.col("content"))).over(Window.partitionBy("query_id").orderBy("rank0").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("used_tokens", used).filter(F.col("used_tokens") <= budget)


def doc_caps(counts: DataFrame, budget: int, floor: int) -> DataFrame:
    """Each document's share of a token budget by its chunks, at least floor, at most all."""
    share = F.floor(F.lit(budget) * F.col("n_chunks") / F.sum("n_chunks").over(Window.partitionBy("query_id")))
    return counts.withColumn("cap", F.least(F.greatest(share, F.lit(floor)), F.lit(budget)).cast("long"))


def section_relevance(sections: DataFrame, hints: DataFrame) -> DataFrame:
    """Scores of sections from scored hint paths: the section itself 1, above it .9, below it .65 of the hint, at most 1.

    Hints reach sections through the prefixes of either path.
    """
    def prefixes(c: Column) -> Column:
        parts = section_parts(c)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), SEP))

    up = sections.select("document_id", "section_path", F.explode(prefixes(F.col("section_path"))).alias("_p")).join(hints.select("document_id", F.col("section_path").alias("_p"), "score"), ["document_id", "_p"])
    up = up.select("document_id", "section_path", (F.col("score") * F.when(F.col("_p") == F.col("section_path"), 1.0).otherwise(0.9)).alias("_s"))
    down = hints.select("document_id", "score", F.col("section_path").alias("_h"), F.explode(prefixes(F.col("section_path"))).alias("section_path")).filter("section_path <> _h").join(sections.select("document_id", "section_path"), ["document_id", "section_path"])
    both = up.unionByName(down.select("document_id", "section_path", (F.col("score") * 0.65).alias("_s")))
    return sections.join(both.groupBy("document_id", "section_path").agg(F.least(F.max("_s"), F.lit(1.0)).alias("relevance")), ["document_id", "section_path"], "left").fillna(0.0, ["relevance"])


def run_summary(steps: DataFrame) -> DataFrame:
    """Query runs from their steps (run_id, query, document_id, tokens, seconds): results, distinct documents, tokens, time."""
    return steps.groupBy("run_id", "query").agg(
        F.count("document_id").alias("n_results"), F.array_sort(F.collect_set("document_id")).alias("documents"), F.sum("tokens").alias("tokens"), F.round(F.sum("seconds"), 3).alias("seconds")
    ).withColumn("query_hash", F.substring(F.sha2("query", 256), 1, 16))


def listed_documents(documents: DataFrame, n: int) -> DataFrame:
    """Each user's newest n documents of a namespace that are not archived."""
    w = Window.partitionBy("user_id", "namespace").orderBy(F.desc("updated_at"), "document_id")
    return documents.filter("status <> 'archived'").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def archived(documents: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Documents of gone become archived at that time."""
    marked = documents.join(gone.select("document_id").distinct().withColumn("_gone", F.lit(True)), "document_id", "left")
    return marked.withColumn("archived_at", F.when(F.col("_gone"), at).otherwise(F.col("archived_at"))).withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def lookup(rows: DataFrame, wanted: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Entities by a key, and the keys that are not there.

    Both sides are dealt to all partitions of a shuffle and merged there. The wanted keys repeat until then, as distinct keys of a
    large file would fill the memory of the task that reads it, and nothing is broadcast, as keys in order take few bytes and many rows.
    """
    known, asked = by_keys(rows, on), by_keys(wanted.select(on), on)
    return known.join(asked.hint("merge"), on, "left_semi"), asked.join(by_keys(rows.select(on), on).hint("merge"), on, "left_anti").distinct()


def tree_evidence(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document one text: its sections in order, indented by level, each with its chunks below, media already in place
    (see with_media). Root has no line of its own. Documents are bounded by what one result holds."""
    root = F.col("section_path") == "Root"
    places = sections.select("document_id", "section_path", F.col("sort_order").alias("_s"), F.when(root, 0).otherwise(F.col("section_level")).alias("_d"))
    heads = sections.filter(~root).select("document_id", F.col("sort_order").alias("_s"), F.lit(-1).alias("_c"), F.concat(F.repeat(F.lit("  "), F.col("section_level") - 1), F.lit("▸ "), "section_title").alias("_line"))
    leaves = chunks.join(places, ["document_id", "section_path"]).select("document_id", "_s", F.col("sort_order").cast("int").alias("_c"), F.concat(F.repeat(F.lit("  "), F.col("_d")), F.lit("┈ "), "content").alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_s", "_c", "_line"))), lambda x: x["_line"])
    return heads.unionByName(leaves).groupBy("document_id").agg(F.array_join(lines, "\n").alias("evidence"))
