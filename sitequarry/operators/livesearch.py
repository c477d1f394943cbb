"""Ranking captured pages for a question without an index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from ..functions.urls import slug
from ..sources.shared import materialised, new_folder
from .totals import within

NOTHING_FOUND = "Nessuna informazione trovata sui siti configurati."


TERM = "[a-z0-9_àèéìíîòóùú]{3,}"  # what tokens are made of: a token that stands in a text stands in one of these


class PageIndex:
    """An inverted index of pages by the words of their anchor (or title) and of their url, in a folder of Parquet.

    postings: (root, term, page, anchor, slug), a row for each word of a page with the fields that hold it; grams: (root, gram, term), the words of a root by each three
    characters in them; pages: (page, root, url, support), a row for each row indexed. Tokens count wherever they stand in a word, so a token finds the words that hold it by its first three
    characters, and then their postings: work follows the words and hits, not questions times pages."""

    def __init__(self, spark, folder: str):
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        self.pages, self.postings, self.grams = read("pages"), read("postings"), read("grams")

    @classmethod
    def build(cls, links: DataFrame, folder: str) -> PageIndex:
        """The index of links (root, url, anchor)."""
        low = links.select("root", "url", F.lower(F.coalesce("anchor", F.lit(""))).alias("anchor"), F.coalesce(slug(F.col("url")), F.lit("")).alias("slug"), F.monotonically_increasing_id().alias("page"))
        rows = materialised(low)
        support = S.any_of(F.col("anchor"), S.SUPPORT_PAGES) | S.any_of(F.col("slug"), S.SUPPORT_PAGES)
        rows.select("page", "root", "url", support.alias("support")).write.parquet(f"{folder}/pages")
        words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(TERM), F.lit(0)))
        both = rows.select("root", "page", words("anchor").alias("a"), words("slug").alias("s")).withColumn("term", F.explode(F.array_union("a", "s")))
        posted = both.select("root", "term", "page", F.array_contains("a", F.col("term")).alias("anchor"), F.array_contains("s", F.col("term")).alias("slug"))
        posted.repartitionByRange("root", "term", "page").sortWithinPartitions("root", "term").write.parquet(f"{folder}/postings")
        spark = links.sparkSession
        terms = spark.read.parquet(f"{folder}/postings").select("root", "term").distinct()
        gram = F.transform(F.sequence(F.lit(1), F.length("term") - 2), lambda i: F.substring("term", i, F.lit(3)))
        terms.select("root", F.explode(F.array_distinct(gram)).alias("gram"), "term").write.parquet(f"{folder}/grams")
        return cls(spark, folder)

    def matches(self, tokens: DataFrame) -> DataFrame:
        """tokens (root, token, others), different ones: their rows with page, anchor, slug, a row for each word of a page that holds the token."""
        asked = tokens.withColumn("gram", F.substring("token", 1, 3))
        words = asked.join(self.grams, ["root", "gram"]).where(F.contains("term", "token")).drop("gram")
        return words.join(self.postings, ["root", "term"]).drop("term")

    def hits(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, root, tokens): query_id, root, page, gain (SCO5 of the tokens), for the pages that some token hits: all of them, so for few questions."""
        each = asked.select("query_id", "root", F.explode("tokens").alias("token")).groupBy("query_id", "root", "token").agg(F.count("*").alias("n"))
        each = materialised(each)
        pages = self.matches(each.select("root", "token").distinct()).groupBy("root", "token", "page").agg(F.bool_or("anchor").alias("anchor"), F.bool_or("slug").alias("slug"))
        gain = F.col("n") * (F.when(F.col("anchor"), 4).otherwise(0) + F.when(F.col("slug"), 3).otherwise(0))
        return each.join(pages, ["root", "token"]).groupBy("query_id", "root", "page").agg(F.sum(gain).cast("int").alias("gain"))

    def best(self, asked: DataFrame, most: int, block_pages: int = 1 << 17, block_queries: int = 4096) -> DataFrame:
        """asked (query_id, root, tokens) -> query_id, root, page, url, score: among them the `most` best pages of each question by score and url.

        Each page gets the tokens that hit it, whoever asks. Blocks of a root's pages then meet blocks of its questions, and a task keeps `most` pages of each question: hits, of which there
        are questions times pages where a word is common, never leave their task. Pages that no token hits have their block's own order, whatever the question (support pages first, or by url alone for a question
        without tokens), so the first `most` of these orders stand for all of them."""
        asked = materialised(asked.where("root is not null").select("query_id", "root", "tokens"))
        named = materialised(asked.select("root", F.explode("tokens").alias("token")).distinct().withColumn("id", F.monotonically_increasing_id()))
        flag = (F.when(F.col("anchor"), 1).otherwise(0) + F.when(F.col("slug"), 2).otherwise(0)).cast("byte")
        hit = self.matches(named).groupBy("page").agg(F.collect_list(F.struct("id", flag.alias("flag"))).alias("h"))
        pages = self.pages.where("root is not null").join(hit, "page", "left").select("root", "page", "url", "support", F.col("h.id").alias("ids"), F.col("h.flag").alias("flags"))
        words = asked.select("query_id", "root", F.explode("tokens").alias("token")).join(named, ["root", "token"]).groupBy("query_id", "root").agg(F.collect_list("id").alias("ids"))
        most_of = lambda df: df.groupBy("root").count().agg(F.max("count")).first()[0] or 0
        blocks, q_blocks = max(1, -(-most_of(self.pages) // block_pages)), max(1, -(-most_of(asked) // block_queries))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        key, kinds = ("root", "block", "q_block"), {c: d.schema[c].dataType.simpleString() for d, c in ((asked, "query_id"), (asked, "root"), (pages, "page"), (pages, "url"))}
        left = asked.select("query_id", "root").distinct().join(words, ["query_id", "root"], "left").withColumn("q_block", part("query_id", q_blocks)).withColumn("block", every(blocks))
        right = pages.withColumn("block", part("page", blocks)).withColumn("q_block", every(q_blocks))
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "root", "page", "url")) + ", score int"

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found, scores = [np.zeros(0, int)] * len(left), [np.zeros(0, np.int32)]
            if len(right):
                right = right.sort_values(["url", "page"], na_position="first", ignore_index=True)
                support, places = right["support"].to_numpy(dtype=bool), _places(right)
                by_support = np.concatenate([np.flatnonzero(support)[:most], np.flatnonzero(~support)[:most]])[:most]
                gain = np.zeros(len(right), np.int32)
                for asking, ids in enumerate(left["ids"]):
                    some = ids is not None and len(ids) > 0
                    touched = [by_support if some else np.arange(min(most, len(right)))]
                    for token in ids if some else ():
                        if token in places:
                            at, worth = places[token]
                            gain[at] += worth
                            touched.append(at)
                    at = np.unique(np.concatenate(touched))
                    score = gain[at] + 5 * support[at] if some else gain[at]
                    gain[at] = 0
                    if len(at) > most:
                        near = score >= -np.partition(-score, most - 1)[most - 1]
                        at, score = at[near], score[near]
                    order = np.argsort(-score, kind="stable")[:most]
                    found[asking] = at[order]
                    scores.append(score[order])
            at, asking = np.concatenate([np.zeros(0, int), *found]), np.repeat(np.arange(len(left)), [len(x) for x in found])
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[asking], "root": left["root"].to_numpy()[asking], "page": right["page"].to_numpy()[at], "url": right["url"].to_numpy()[at], "score": np.concatenate(scores)})

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)


def _places(pages: pd.DataFrame) -> dict:
    """Of each token's number the rows that it hits, in order, and what it gives to each (SCO5): 4 in the anchor, 3 in the url."""
    lists = [x is not None for x in pages["ids"]]
    row = np.repeat(np.flatnonzero(lists), [len(x) for x in pages["ids"][lists]])
    if not len(row):
        return {}
    token, flag = (np.concatenate(pages[c][lists].to_list()) for c in ("ids", "flags"))
    order = np.lexsort((row, token))
    token, row, flag = token[order], row[order], flag[order]
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (row[1:] != row[:-1])])
    flag = np.bitwise_or.reduceat(flag, first)
    token, row = token[first], row[first]
    worth = np.array([0, 4, 3, 7], np.int32)[flag]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    return {t: (row[a:z], worth[a:z]) for t, a, z in zip(token[begin].tolist(), begin, [*begin[1:], len(token)])}


def candidates(queries: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """SCO5, TOP5: queries (query_id, root, query) x links (root, url, anchor) of the same root -> the best links, by an index of them."""
    index = PageIndex.build(links, new_folder(links.sparkSession, "index"))
    scored = index.best(queries.select("query_id", "root", S.tokens(F.col("query")).alias("tokens")), most).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "page")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("page")


def visiting_order(scored: DataFrame, batch: int = 6, most: int = 60) -> DataFrame:
    """TOP6: position and batch of each page in best-first order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    return scored.withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < most).withColumn("batch", F.floor(F.col("position") / batch).cast("int"))


def early_stop(visited: DataFrame, score_least: int = 10, chars_least: int = 300, hits: int = 3, grace: int = 2) -> DataFrame:
    """WIN10: visited (query_id, position, batch, complexity, strategy, relevance, chars) cut where the search would have stopped:
    a simple question at its first good page, another after the third and two more batches, a comprehensive one never."""
    good = (F.col("relevance") >= score_least) & (F.col("chars") > chars_least)
    w = Window.partitionBy("query_id").orderBy("position")
    counted = visited.withColumn("_good", F.sum(good.cast("int")).over(w))
    whole = Window.partitionBy("query_id")
    first_at = F.min(F.when(F.col("_good") >= 1, F.col("position"))).over(whole)
    third_in = F.min(F.when(F.col("_good") >= hits, F.col("batch"))).over(whole)
    counted = counted.withColumns({"_first": first_at, "_third": third_in})
    simple = F.col("_first").isNull() | (F.col("position") <= F.col("_first"))
    other = F.col("_third").isNull() | (F.col("batch") <= F.col("_third") + grace)
    keep = F.when(F.col("strategy") == "comprehensive", True).when(F.col("complexity") <= 1, simple).otherwise(other)
    return counted.where(keep).drop("_good", "_first", "_third")


def page_block(p: str = "") -> Column:
    """FUN5: a page as it stands in a live context; lines without a value are left out."""
    c = lambda n: F.col(f"{p}{n}")
    return T.labelled_lines(
        ("### Pagina: ", F.coalesce(F.nullif(c("title"), F.lit("")), c("url"))), ("URL: ", c("url")), ("Descrizione: ", c("description")),
        ("Sezioni: ", F.array_join(F.slice(c("headings"), 1, 8), " | ")), ("Telefoni: ", F.array_join(c("phones"), ", ")), ("Email: ", F.array_join(c("emails"), ", ")),
        ("Indirizzi: ", F.array_join(c("addresses"), "; ")), ("Orari: ", F.array_join(c("opening_hours"), " | ")), ("Contenuto:\n", F.substring(c("raw_text"), 1, 1200)),
    )


def live_context(ranked: DataFrame, most: int = 14000, few: bool = False) -> DataFrame:
    """WIN9: rows (query_id, position, block): a block is in if what stands before it is shorter than `most`. few: see totals.within."""
    kept = within(ranked.select("query_id", "position", "block"), "query_id", "position", "block", most - 1, few=few)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_before", "block"))), lambda x: x["block"]), "\n").alias("context"), F.count("*").alias("pages"))


def context_lists(pages: DataFrame, results: DataFrame, most_results: int = 6, most_pages: int = 40, link_pages: int = 10, links_each: int = 3) -> DataFrame:
    """TOP7: what stands at the end of a live context. pages (query_id, position, title, url, named_links) and results (query_id, position, title, url,
    snippet) -> query_id, results, pages, links: lines of the first results, of the first pages, and of the first links of fewer pages."""
    ranked = lambda df, n: df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "url"))).where(F.col("_n") <= n)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", c.alias("line")))), lambda x: x["line"]), "\n")
    linked = lambda text, url: F.concat(F.lit("- ["), text, F.lit("]("), url, F.lit(")"))
    found = ranked(results, most_results).groupBy("query_id").agg(joined(F.concat(linked(F.col("title"), F.col("url")), F.lit("\n  "), F.col("snippet"))).alias("results"))
    useful = F.array_join(F.transform(F.slice("named_links", 1, links_each), lambda a: linked(a["text"], a["url"])), "\n")
    own = ranked(pages, most_pages).withColumn("_links", F.when(F.col("_n") <= link_pages, F.nullif(useful, F.lit(""))))
    listed = own.groupBy("query_id").agg(joined(F.concat(F.lit("- "), F.col("url"), F.lit(' → "'), F.col("title"), F.lit('"'))).alias("pages"), joined(F.col("_links")).alias("links"))
    return listed.join(found, "query_id", "full_outer").select("query_id", F.coalesce("results", F.lit("")).alias("results"), F.coalesce("pages", F.lit("")).alias("pages"), F.coalesce("links", F.lit("")).alias("links"))


def search_pages(queries: DataFrame, documents: DataFrame, most: int = 60, most_chars: int = 14000) -> DataFrame:
    """LIV1: queries (query_id, root, query) over extracted documents (root, url, title, ...): the context of each query. An index of titles and urls says which pages are
    visited, `most` for a question; only these are read, for their relevance and their block. documents are read three times: what is costly to make should be kept first."""
    index = PageIndex.build(documents.select("root", "url", F.col("title").alias("anchor")), new_folder(documents.sparkSession, "index"))
    analysed = materialised(queries.select("query_id", "root", S.query_analysis(F.col("query")).alias("a")))
    scored = index.best(analysed.select("query_id", "root", F.col("a.tokens").alias("tokens")), most)
    visited = visiting_order(scored, most=most).join(analysed.drop("root"), "query_id")
    relevance = S.page_relevance(F.col("a.tokens"), F.col("title"), F.col("description"), F.col("headings"), F.col("raw_text"))
    block = page_block()
    read = documents.select("root", "url", "title", "description", "headings", "raw_text", F.length(block).alias("size"), F.xxhash64(block).alias("block_hash"))
    rows = visited.join(read, ["root", "url"]).select("query_id", "position", "batch", "root", "url", "size", "block_hash", relevance.alias("relevance"), F.col("a.complexity").alias("complexity"), F.col("a.strategy").alias("strategy"), F.length("raw_text").alias("chars"))
    kept = early_stop(rows)
    # sizes say which blocks are in; only those meet their texts
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "position")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = kept.select("query_id", "root", "url", "block_hash", F.row_number().over(w).alias("position"), before.alias("before")).where(F.col("before") < most_chars).drop("before")
    blocks = documents.select("root", "url", F.xxhash64(block).alias("block_hash"), block.alias("block")).dropDuplicates(["root", "url", "block_hash"])
    found = live_context(ranked.join(blocks, ["root", "url", "block_hash"]), most_chars, few=True)  # `most` pages of a question at most
    return queries.select("query_id", "query").join(found, "query_id", "left").select("query_id", "query", F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context"), F.coalesce("pages", F.lit(0)).alias("pages"))


# In which order a strategy asks its sources.
SOURCE_ORDER = {"scraper_first": ("scraper", "crawler", "api"), "crawler_first": ("crawler", "scraper", "api"), "parallel": ("scraper", "crawler", "api")}


def routed_results(queries: DataFrame, results: DataFrame, api: bool = True, scraper: bool = True, crawler: bool = True) -> DataFrame:
    """LIV2: queries (query_id, query) over the results of each source (query_id, source, ...): the strategy that the question's intent asks for decides
    in which order sources count; the first that suffices answers, else all are merged. In parallel, all are merged at once. A source that is off is not asked."""
    strategy = S.search_strategy(S.query_intent(F.col("query")), F.lit(api), F.lit(scraper), F.lit(crawler))
    asked = queries.select("query_id", strategy.alias("strategy"))
    on = [name for name, flag in (("api", api), ("scraper", scraper), ("crawler", crawler)) if flag]
    place = F.coalesce(*[F.when(F.col("strategy") == s, F.array_position(F.array(*map(F.lit, order)), F.col("source"))) for s, order in SOURCE_ORDER.items()], F.lit(0))
    ordered = results.where(F.col("source").isin(*on)).join(asked, "query_id").withColumn("source_order", place.cast("int")).where("source_order > 0")
    alone = merged_results(ordered.where("strategy <> 'parallel'"))
    together = merged_results(ordered.where("strategy = 'parallel'"), first_sufficient=False)
    return asked.join(alone.unionByName(together), "query_id", "left").withColumns({"success": F.coalesce("success", F.lit(False)), "sources": F.coalesce("sources", F.lit(0))})


def merged_results(results: DataFrame, key: str = "query_id", first_sufficient: bool = True) -> DataFrame:
    """LIV2, AGG11-12: per query the first source that suffices by itself (if first_sufficient), else all that look sound, merged: arrays joined in source order, different
    values, ten at most, and `success` if two signals are there. results: query_id, source_order, success, phones, emails, addresses, forms, services, text_content."""
    ok = F.col("success") & S.is_plausible(F.col("phones"), F.col("emails"), F.col("addresses"), F.col("text_content"))
    enough = S.sufficient(F.col("phones"), F.col("emails"), F.col("text_content"), F.col("services"), F.col("forms"), F.array().cast("array<string>"))
    sound = results.where(ok).withColumn("_enough", enough)
    first = F.min(F.when(F.col("_enough"), F.col("source_order"))).over(Window.partitionBy(key))
    kept = sound.withColumn("_first", first if first_sufficient else F.lit(None).cast("int")).where(F.col("_first").isNull() | (F.col("source_order") == F.col("_first")))
    listed = lambda c: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_order", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))), 1, 10).alias(c)
    names = ("phones", "emails", "addresses", "forms", "services")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "text_content"))), lambda x: x["text_content"]), "\n").alias("text_content")
    merged = kept.groupBy(key).agg(*[listed(n) for n in names], text, F.count("*").alias("sources"))
    none = F.array().cast("array<string>")
    return merged.withColumn("success", S.sufficient(F.col("phones"), F.col("emails"), F.col("text_content"), F.col("services"), F.col("forms"), none))


def all_roots(*tables: DataFrame) -> DataFrame:
    """SET1: the pages of several roots, as a bag."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
