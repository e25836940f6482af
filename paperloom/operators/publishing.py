"""State, reports and public documents of a feed: what was published and failed, runs, sitemaps, robots rules.

State is a folder of tables, one for each section, that a batch replaces or adds to; documents are strings, one a file of
bounded size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import urls as U

#: Schemas of the sections of a state.
SECTIONS = {
    "published": "key string, url string, title string, source string, category string, at timestamp",
    "failed": "key string, url string, title string, attempts int, last_at timestamp, reason string",
    "seen_titles": "fingerprint string, at timestamp",
    "quota": "name string, day date, used long",
    "queue": "url string, place long",
    "runs": "run_id string, at timestamp, ok boolean",
}
#: Attempts that a permanent failure counts for.
FOR_GOOD = 99


class State:
    """Tables of a state in a folder. Each save of a section goes to a new version, and a small table names the versions, so that a job
    that dies leaves the state as it was; unknown sections are not read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> dict[str, str]:
        try:
            rows = self.spark.read.schema("section string, version string, seq long").parquet(f"{self.root}/_versions").groupBy("section").agg(F.max_by("version", "seq").alias("version"), F.max("seq").alias("seq")).collect()
        except Exception as e:  # noqa: BLE001  no state yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        return {r["section"]: r["version"] for r in rows if r["section"] in SECTIONS}  # a row a section

    def load(self, section: str) -> DataFrame:
        version = self._versions().get(section)
        if version is None:
            return self.spark.createDataFrame([], SECTIONS[section])
        return self.spark.read.schema(SECTIONS[section]).parquet(f"{self.root}/{section}/{version}")

    def save(self, section: str, rows: DataFrame) -> None:
        """Replaces a section; rows may come from its present version."""
        import time
        import uuid

        version, seq = uuid.uuid4().hex, time.time_ns()
        rows.select(*[f.split()[0] for f in SECTIONS[section].split(", ")]).write.parquet(f"{self.root}/{section}/{version}")
        self.spark.createDataFrame([(section, version, seq)], "section string, version string, seq long").coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")

    def stats(self) -> DataFrame:
        """(section, rows)."""
        out = None
        for s in SECTIONS:
            one = self.load(s).agg(F.lit(s).alias("section"), F.count(F.lit(1)).alias("rows"))
            out = one if out is None else out.unionByName(one)
        return out


def state_key(url: Column) -> Column:
    """Key of an address in the state."""
    return U.short_hash(U.canonical_url(url), 20)


def mark_published(published: DataFrame, failed: DataFrame, seen: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sections after new rows (key, url, title, source, category, at, fingerprint) were published: they replace those of their key, clear its
    failures, and their headlines are remembered."""
    one = new.groupBy("key").agg(F.max_by(F.struct("url", "title", "source", "category", "at", "fingerprint"), "at").alias("r")).select("key", "r.*")
    kept = published.join(one.select("key"), "key", "left_anti").unionByName(one.drop("fingerprint"))
    titles = seen.unionByName(one.filter(F.length("fingerprint") > 0).select("fingerprint", "at")).groupBy("fingerprint").agg(F.max("at").alias("at"))
    return kept, failed.join(one.select("key"), "key", "left_anti"), titles


def record_failures(failed: DataFrame, new: DataFrame) -> DataFrame:
    """The failures after new rows (key, url, title, at, reason, permanent) were added: attempts are summed, the latest tells the reason."""
    rows = failed.select("key", "url", "title", "attempts", F.col("last_at").alias("at"), "reason").unionByName(new.select("key", "url", "title", F.when(F.col("permanent"), FOR_GOOD).otherwise(1).alias("attempts"), "at", F.substring("reason", 1, 300).alias("reason")))
    last = F.max_by(F.struct("url", "title", "reason"), "at")
    return rows.groupBy("key").agg(last.alias("r"), F.sum("attempts").cast("int").alias("attempts"), F.max("at").alias("last_at")).select("key", "r.url", "r.title", "attempts", "last_at", "r.reason")


def prune(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days; those without a time stay."""
    return rows.filter(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(F.lit(days))))


def enqueue(queue: DataFrame, new: DataFrame, keep: int = 500) -> DataFrame:
    """The queue (url, place) after addresses (url, place) were put behind it: each once, at its first place, the latest kept."""
    last = queue.agg(F.coalesce(F.max("place"), F.lit(0)).alias("last"))
    rows = queue.unionByName(new.crossJoin(F.broadcast(last)).select("url", (F.col("place") + F.col("last") + 1).alias("place")))  # one row
    first = rows.filter(F.length("url") > 0).groupBy("url").agg(F.min("place").alias("place"))
    return first.orderBy(F.col("place").desc()).limit(keep)


def pop(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n of a queue, the rest)."""
    taken = queue.orderBy("place").limit(n)
    return taken, queue.join(taken.select("url"), "url", "left_anti")


def requeue(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue with addresses (url, place) put before it."""
    first = queue.agg(F.coalesce(F.min("place"), F.lit(0)).alias("first"), F.lit(1).alias("one"))
    most = failed.agg(F.coalesce(F.max("place"), F.lit(0)).alias("most"))
    front = failed.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(most)).select("url", (F.col("first") - 1 - F.col("most") + F.col("place")).alias("place"))  # one row each
    return front.unionByName(queue.join(failed.select("url"), "url", "left_anti"))


def record_run(runs: DataFrame) -> DataFrame:
    """(total, consecutive_failures, last_run, last_success) of runs (at, ok): failures since the last success."""
    last = runs.agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"))
    since = F.col("last_success").isNull() | (F.col("at") > F.col("last_success"))
    return runs.crossJoin(F.broadcast(last)).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok") & since).alias("consecutive_failures"), F.max("at").alias("last_run"), F.first("last_success").alias("last_success"))  # one row


def rebuilt(posts: DataFrame) -> DataFrame:
    """The published section out of posts (source, title, at): what a lost state is restored from."""
    return posts.select(state_key(F.col("source")).alias("key"), F.col("source").alias("url"), "title", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("category"), "at").dropDuplicates(["key"])


def schedule(posts: DataFrame, order: str, start: Column, minutes: int) -> DataFrame:
    """posts with the column due: the first now (null), each other so many minutes after the one before. For one run's posts."""
    i = F.row_number().over(Window.orderBy(order)) - 1
    return posts.withColumn("_i", i).withColumn("due", F.when(F.col("_i") > 0, start + F.make_dt_interval(mins=F.col("_i") * minutes))).drop("_i")


# Reports


def report(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, published, skipped, failed, words, quality) of outcomes (run_id, status, words, quality)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return outcomes.groupBy(run).agg(n("published", "dry-run").alias("published"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.sum(F.coalesce("words", F.lit(0))).alias("words"), F.round(F.avg("quality"), 4).alias("quality"))


def healthy(reports: DataFrame, least: int = 4) -> DataFrame:
    """reports with the column ok: a run that published nothing is not, if one failed or as many as least were tried."""
    tried = F.col("published") + F.col("failed") + F.col("skipped")
    return reports.withColumn("ok", ~((F.col("published") == 0) & ((F.col("failed") > 0) | (tried >= least))))


def reasons(rejected: DataFrame, reason: str) -> DataFrame:
    """(reason, n): how many each reason rejected, what it quotes left out."""
    bare = F.trim(F.split_part(reason, F.lit("'"), F.lit(1)))
    return rejected.groupBy(F.when(bare == "", F.col(reason)).otherwise(bare).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept_runs(runs: DataFrame, keep: int = 60) -> DataFrame:
    """The newest runs, by id."""
    return runs.orderBy(F.col("run_id").desc()).limit(keep)


def markdown(rows: DataFrame, columns: list[str], most: int = 30) -> str:
    """A Markdown table of at most so many rows."""
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|")[:90]
    lines = [" | ".join(columns), " | ".join("---" for _ in columns), *(" | ".join(cell(r[c]) for c in columns) for r in rows.select(*columns).limit(most).collect())]
    return "\n".join(f"| {x} |" for x in lines)


def dashboard(runs: DataFrame, posts: DataFrame, site: str, most_runs: int = 30, most_posts: int = 40) -> str:
    """A static page of the latest runs and posts."""
    import html

    def rows(df: DataFrame, n: int) -> str:
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v if v is not None else ''))}</td>" for v in r) + "</tr>" for r in df.limit(n).collect())
        return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + f"</tr>{body}</table>"

    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="robots" content="noindex"><title>{html.escape(site)}</title></head><body><h1>{html.escape(site)}</h1><h2>Runs</h2>{rows(runs, most_runs)}<h2>Posts</h2>{rows(posts, most_posts)}</body></html>'


# Sitemaps

#: Addresses of a sitemap file; days that news count for.
CHUNK, NEWS_DAYS = 49_000, 2
_SITEMAP = "http://www.sitemaps.org/schemas/sitemap/0.9"
_KINDS = {"news": ' xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"', "image": ' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"', "": ""}


def xml(text: Column) -> Column:
    """The five signs that XML escapes."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def change_frequency(days: Column) -> Column:
    return F.when(days <= 1, "hourly").when(days <= 7, "daily").when(days <= 30, "weekly").when(days <= 180, "monthly").otherwise("yearly")


def priority(days: Column, first: Column) -> Column:
    base = F.when(days <= 1, 0.9).when(days <= 7, 0.8).when(days <= 30, 0.6).otherwise(0.4)
    return F.format_string("%.1f", F.when(first, F.least(F.lit(1.0), base + 0.1)).otherwise(base))


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _files(entries: DataFrame, order: list[Column], kind: str, chunk: int) -> DataFrame:
    """(file, urls, document) of entries with a column entry. Places are counted by ranges, so that no task orders all of them."""
    from paperloom.session import cut

    ranged = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "sitemap-entries")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("start"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    placed = ranged.join(F.broadcast(before.select("_part", "start", "before")), "_part").withColumn("place", F.col("before") + F.col("_id") - F.col("start"))
    files = placed.groupBy(F.floor(F.col("place") / chunk).cast("int").alias("file")).agg(F.count(F.lit(1)).alias("urls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "\n").alias("body"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{_SITEMAP}"{_KINDS[kind]}>\n'
    return files.select("file", "urls", F.concat(F.lit(head), F.col("body"), F.lit("\n</urlset>\n")).alias("document"))


def _tags(*pairs: tuple[str, Column]) -> Column:
    return F.concat(F.lit("  <url>"), *[x for t, c in pairs for x in (F.lit(f"<{t}>"), c, F.lit(f"</{t.split()[0]}>"))], F.lit("</url>"))


def sitemap(posts: DataFrame, now: Column, chunk: int = CHUNK) -> DataFrame:
    """(file, urls, document) of posts (url, published), the newest first: times, frequency and priority by age. Posts without an address are left out, those
    without a time are as old as now."""
    p = posts.filter(F.length(F.trim("url")) > 0).withColumn("at", F.coalesce("published", now)).withColumn("days", F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400))
    newest = p.agg(F.max(F.struct("at", "url")).alias("m"))
    p = p.crossJoin(F.broadcast(newest)).withColumn("first", F.struct("at", "url") == F.col("m"))  # one row
    p = p.withColumn("entry", _tags(("loc", xml(F.col("url"))), ("lastmod", _stamp(F.col("at"))), ("changefreq", change_frequency(F.col("days"))), ("priority", priority(F.col("days"), F.col("first")))))
    return _files(p, [F.col("at").desc(), F.col("url")], "", chunk)


def news_sitemap(posts: DataFrame, now: Column, site: str, language: str = "en", most: int = 1000) -> DataFrame:
    """The same of the newest posts (url, title, published) of the last two days, with their headlines."""
    fresh = posts.filter((F.length("url") > 0) & (F.length("title") > 0) & (F.unix_timestamp("published") >= F.unix_timestamp(now) - NEWS_DAYS * 86400)).orderBy(F.col("published").desc(), "url").limit(most)
    part = F.concat(F.lit(f"<news:publication><news:name>{site}</news:name><news:language>{language}</news:language></news:publication><news:publication_date>"), _stamp(F.col("published")), F.lit("</news:publication_date><news:title>"), xml(F.col("title")), F.lit("</news:title>"))
    return _files(fresh.withColumn("entry", _tags(("news:news", part), ("loc", xml(F.col("url"))))), [F.col("published").desc(), F.col("url")], "news", CHUNK)


def image_sitemap(posts: DataFrame, most: int = 1000) -> DataFrame:
    """The same of posts (url, title, image, published) with a picture."""
    p = posts.filter((F.length("url") > 0) & (F.length("image") > 0)).orderBy(F.col("published").desc_nulls_last(), "url").limit(most)
    title = F.when(F.length("title") > 0, F.concat(F.lit("<image:title>"), xml(F.substring("title", 1, 100)), F.lit("</image:title>"))).otherwise("")
    part = F.concat(F.lit("<image:loc>"), xml(F.col("image")), F.lit("</image:loc>"), title)
    return _files(p.withColumn("entry", _tags(("loc", xml(F.col("url"))), ("image:image", part))), [F.col("published").desc_nulls_last(), F.col("url")], "image", CHUNK)


def sitemap_index(addresses: list[str], stamp: str) -> str:
    rows = "\n".join(f"  <sitemap><loc>{a.replace('&', '&amp;')}</loc><lastmod>{stamp}</lastmod></sitemap>" for a in addresses if a)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{_SITEMAP}">\n{rows}\n</sitemapindex>\n'


def sitemap_problems(files: DataFrame, most_bytes: int = 49 << 20) -> DataFrame:
    """(file, problem): no declaration, no or relative addresses, spaces and bare ampersands in them, size."""
    loc = F.regexp_extract_all("document", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    tests = ((~F.col("document").startswith("<?xml"), "no declaration"), (F.size(loc) == 0, "no address"), (F.exists(loc, lambda u: ~u.startswith("http")), "relative address"), (F.exists(loc, lambda u: u.rlike(r" |&(?!(?:amp|lt|gt|quot|apos);)")), "unescaped address"), (F.octet_length("document") > most_bytes, "too large"))
    return files.select("file", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))).alias("problem"))


# Robots rules


def robots(site: str = "", sitemaps: list[str] | None = None, blocked: list[str] | None = None, bots: list[str] | None = None, delay: int = 0) -> str:
    """Rules for robots: bots that may read nothing, paths that nobody may read, where the sitemaps are."""
    parts = [f"User-agent: {b}\nDisallow: /\n" for b in bots or []]
    parts.append("\n".join(["User-agent: *", *(f"Disallow: {p}" for p in dict.fromkeys(blocked or [])), "Allow: /", *([f"Crawl-delay: {delay}"] if delay else [])]) + "\n")
    tail = ([f"Host: {re.sub('^https?://', '', site.strip()).rstrip('/')}"] if site.strip() else []) + [f"Sitemap: {u}" for u in sitemaps or [] if u]
    return "\n".join([*parts, *tail]).rstrip() + "\n"


def robots_rules(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, agent, allow, pattern) of robots files: each rule under every agent of its group. A group is a run of agent lines and the
    rules behind it; its number is that of the agent lines that begin one, counted within the file."""
    lines = files.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter(F.instr("raw", ":") > 0)
    lines = lines.select(key, "line", F.lower(F.trim(F.split_part("raw", F.lit(":"), F.lit(1)))).alias("word"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value")).filter(F.col("word").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy(key).orderBy("line")
    starts = ((F.col("word") == "user-agent") & (F.coalesce(F.lag("word").over(order), F.lit("")) != "user-agent")).cast("int")
    grouped = lines.withColumn("_new", starts).withColumn("group", F.sum("_new").over(order)).drop("_new")
    agents = grouped.filter(F.col("word") == "user-agent").select(key, "group", F.lower("value").alias("agent"))
    rules = grouped.filter((F.col("word") != "user-agent") & (F.col("value") != "")).select(key, "group", "line", (F.col("word") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return rules.join(agents, [key, "group"]).select(key, "line", "agent", "allow", "pattern")


def allowed(paths: DataFrame, rules: DataFrame, key: str, agent: str = "*") -> DataFrame:
    """paths (key, path) with the column allowed: by the longest pattern that fits, of the agent's rules or else of everyone's; stars stand for
    anything, and what no rule names is allowed."""
    named = rules.filter(F.col("agent") == agent.lower()).select(key).distinct()
    own = rules.filter(F.col("agent") == agent.lower()).unionByName(rules.filter(F.col("agent") == "*").join(named, key, "left_anti")).select(key, "allow", "pattern").distinct()
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*")
    p = paths.select(key, "path").distinct().withColumn("_id", F.xxhash64("path"))
    fit = p.join(own.withColumn("re", F.concat(F.lit("^"), quoted)), key).filter(F.expr("path RLIKE re"))
    best = fit.groupBy(key, "path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("b"))
    return paths.join(best, [key, "path"], "left").withColumn("allowed", F.coalesce("b.allow", F.lit(True))).drop("b")


def robots_problems(text: str) -> list[str]:
    """What is wrong with robots rules: lines without a colon, rules before any agent, paths and sitemaps that are not absolute, unknown words, or
    nothing left for anyone to read."""
    out, agents, agent = [], 0, ""
    for raw in text.splitlines():
        line = " ".join(raw.split())
        if not line or line.startswith("#"):
            continue
        word, colon, value = (x.strip() for x in line.partition(":"))
        word = word.lower()
        if not colon:
            out.append(f"no colon: {line[:50]}")
        elif word == "user-agent":
            agents, agent = agents + 1, value
            out += [] if value else ["empty agent"]
        elif word in ("allow", "disallow"):
            out += ["rule before any agent"] * (not agents) + [f"relative path: {value[:40]}"] * bool(value and not value.startswith("/"))
            out += ["everyone is kept out"] * (word == "disallow" and value == "/" and agent == "*")
        elif word == "sitemap":
            out += [] if value.startswith("http") else [f"relative sitemap: {value[:40]}"]
        elif word not in ("crawl-delay", "host", "noindex", "request-rate", "clean-param"):
            out.append(f"unknown word: {word}")
    return out + ["no agent"] * (not agents)
