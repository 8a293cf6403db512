"""URLs, pages, robots rules and crawl order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let

_TRACKING = "^(utm_.*|ref|fbclid|gclid)$"


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` segments; ``..`` takes the segment before; a closing slash stays."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    body = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(path.endswith("/") & (body != "/"), F.concat(body, F.lit("/"))).otherwise(body)


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, port, path, query of an http address; null for others. Fragment and user are dropped, a default port too."""
    def cut(u: Column) -> Column:
        pick = lambda k: F.regexp_extract(u, "(?i)^(https?)://(?:[^/@]*@)?([^/:?]*)(?::([0-9]+))?([^?]*)(?:\\?(.*))?$", k)
        return F.struct(F.lower(pick(1)).alias("scheme"), F.lower(pick(2)).alias("host"), pick(3).alias("port"), pick(4).alias("path"), pick(5).alias("query"))

    def tidy(p: Column) -> Column:
        usual = (p["port"] == "") | ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
        keys = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).rlike(_TRACKING))
        pairs = F.transform(F.array_sort(F.transform(keys, lambda q, i: F.struct(F.substring_index(q, "=", 1).alias("k"), i.alias("i"), F.regexp_replace(q, "=$", "").alias("p")))), lambda e: e["p"])
        return F.when((p["scheme"] != "") & (p["host"] != ""), F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), F.when(~usual, p["port"]).alias("port"), let(p["path"], normal_path).alias("path"), F.array_join(pairs, "&").alias("query")))

    return let(let(F.regexp_replace(F.trim(url), "#.*$", ""), cut), tidy)


def normalize_url(url: Column) -> Column:
    return let(url_parts(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"].isNull(), "").otherwise(F.concat(F.lit(":"), p["port"])), p["path"], F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), "\\s+", " "))


def entities(text: Column) -> Column:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def visible_text(html: Column) -> Column:
    """The text of a page: comments, scripts, styles and tags go, tags leave a space, entities are decoded, white space is single."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", " ")
    t = F.regexp_replace(t, "(?is)<title[^>]*>.*?</title>", " ")
    return F.trim(F.regexp_replace(entities(F.regexp_replace(t, "<[^>]*>", " ")), "\\s+", " "))


def links(html: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*href\\s*=\\s*(\"[^\"]*\"|'[^']*')"), F.lit(1)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))


def resolve(base: Column, rel: Column) -> Column:
    """An absolute, canonical address of ``rel`` seen from ``base``; null for other schemes."""
    def full(p: Column) -> Column:
        root = F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"].isNull(), "").otherwise(F.concat(F.lit(":"), p["port"])))
        folder = F.regexp_replace(p["path"], "[^/]*$", "")
        return (F.when(rel.rlike("(?i)^https?://"), rel).when(rel.rlike("(?i)^(mailto|javascript|tel|data):"), None).when(rel.startswith("//"), F.concat(p["scheme"], F.lit(":"), rel))
                .when(rel.startswith("#") | (rel == ""), base).when(rel.startswith("?"), F.concat(root, p["path"], rel)).when(rel.startswith("/"), F.concat(root, rel)).otherwise(F.concat(root, folder, rel)))

    return let(let(url_parts(base), full), normalize_url)


def host_key(parts: Column) -> Column:
    """host, or host:port."""
    return F.concat_ws(":", parts["host"], parts["port"])


def page_fields(url: Column, html: Column) -> list[Column]:
    """title, text and links: the absolute, canonical addresses of a page's links, each once, in order."""
    found = F.array_distinct(F.filter(F.transform(links(html), lambda h: resolve(url, entities(h))), lambda x: x.isNotNull()))
    return [title(html).alias("title"), visible_text(html).alias("text"), found.alias("links")]


def schedule(urls: DataFrame) -> DataFrame:
    """Hosts in turn: (wave, host, url); each wave takes one address of every host, in order of ``seq``."""
    w = Window.partitionBy("host").orderBy("seq")
    return urls.withColumn("wave", F.row_number().over(w))


class Frontier:
    """Addresses to fetch, each once for all time, in the order they came: (url, host, seq, state), state new or done."""

    SCHEMA = "url string, host string, seq long, state string"

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def empty(cls, spark) -> "Frontier":
        return cls(spark.createDataFrame([], cls.SCHEMA))

    def push(self, urls: DataFrame) -> "Frontier":
        """With the addresses of (url, seq) that are good and were never seen; of equal ones the least seq counts."""
        parts = urls.select(normalize_url(F.col("url")).alias("url"), "seq").filter("url IS NOT NULL")
        new = parts.groupBy("url").agg(F.min("seq").alias("seq")).join(self.table.select("url"), "url", "left_anti")
        return Frontier(self.table.unionByName(new.select("url", host_key(url_parts(F.col("url"))).alias("host"), "seq", F.lit("new").alias("state"))))

    def pop_polite(self) -> DataFrame:
        """(url, host, seq): the first waiting address of every host, hosts by their own least seq."""
        w = Window.partitionBy("host").orderBy("seq", "url")
        return self.table.filter("state = 'new'").withColumn("r", F.row_number().over(w)).filter("r = 1").select("url", "host", "seq")

    def done(self, urls: DataFrame) -> "Frontier":
        gone = urls.select("url", F.lit(True).alias("gone"))
        return Frontier(self.table.join(gone, "url", "left").select("url", "host", "seq", F.when(F.col("gone"), "done").otherwise(F.col("state")).alias("state")))

    def seen_count(self) -> int:
        return self.table.count()

    def queue_len(self) -> int:
        return self.table.filter("state = 'new'").count()

    def is_empty(self) -> bool:
        return self.table.filter("state = 'new'").isEmpty()


def next_delay(last: dict[str, float], waiting: set[str], now: float, cooldown: float = 0.5) -> float | None:
    """Seconds until some waiting host may be asked again; None if nothing waits."""
    return min((max(0.0, last[h] + cooldown - now) if h in last else 0.0 for h in waiting), default=None)
