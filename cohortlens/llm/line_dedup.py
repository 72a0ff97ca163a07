"""Site-relative line deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tags that end a line of a page's text (fixed values).
BLOCK_TAGS = ("html head body title style script nav ul ol li div p br article section header footer main aside table tr "
              "td th blockquote pre h1 h2 h3 h4 h5 h6 meta link").split()
PAGE_LINES = r"(?i)\n|<(?:/?(?:" + "|".join(BLOCK_TAGS) + r")\b|!)[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"
RATIO, MIN_PAGES = 0.1, 2


def host_of(url: Column) -> Column:
    """Lower-case host of an address; null if there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def page_text(html: Column) -> Column:
    """The text runs of a page between its block tags, trimmed, one a line."""
    runs = F.transform(F.split(html, PAGE_LINES), lambda x: F.trim(x))
    return F.array_join(F.filter(runs, lambda x: x != ""), "\n")


def _mark(line: Column) -> Column:
    # 96 bits of hash stand for a line, in counts and in the lists of a host.
    return F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("m"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): marks of the lines on more than ``ratio`` of a host's
    pages and on ``min_pages`` at least. A page counts once for a line.

    A host has at most (mean lines of a page) / ``ratio`` such lines, which
    bounds its list at any number of pages."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), _mark))).alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = seen.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def line_dedup(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of the text,
    and dropped_lines (int; a column of that name is replaced).

    Lines end at a line feed and are compared as they are; empty lines stay.
    Pages of a null host are not compared and stay whole; a null text stays
    null (0 dropped); every input row, repeated ones too, counts as a page
    and gives one row; an empty table gives an empty result.

    (host, line) pairs are counted with partial sums before their shuffle,
    so a hot host or line meets in counts only. The hosts' lists are written
    once, so Spark knows their size: it broadcasts short ones, and can split
    a hot host in the join with long ones."""
    marks = stored(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate").select(F.col("host").alias("_host"), F.col("lines").alias("_marks"))
    keep = [c for c in docs.columns if c not in ("dropped_lines", text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("_text"), F.col(host_col).alias("_of"))
    rows = rows.join(marks, F.col("_of") == F.col("_host"), "left")
    lines = F.split("_text", "\n")
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains(F.col("_marks"), _mark(x)))
    changed = F.col("_marks").isNotNull() & F.col("_text").isNotNull()
    rows = rows.withColumn("_kept", F.when(changed, kept))
    text = F.when(changed, F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    out = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c != "dropped_lines"]
    return rows.select(*out, F.when(changed, F.size(lines) - F.size("_kept")).otherwise(0).alias("dropped_lines"))


def page_line_dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, text, dropped_lines of crawled pages (page_id, url, html)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    return line_dedup(rows, "host", "text", ratio, min_pages)


ORACLE = f"""
with p as (
  select row_number() over () as r, page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') as host,
         list_filter(list_transform(regexp_split_to_array(html, '{PAGE_LINES}'), lambda x: trim(x)), lambda x: x <> '') as ls
  from pages),
t as (select host, count(*) as pages from p where host is not null group by host),
l as (select r, host, unnest(list_distinct(ls)) as line from p where host is not null),
b as (select l.host, l.line from l join t on l.host = t.host group by l.host, l.line, t.pages
      having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * t.pages),
m as (select host, list(line) as bad from b group by host)
select p.page_id, p.host,
       array_to_string(case when m.bad is null then p.ls else list_filter(p.ls, lambda x: not list_contains(m.bad, x)) end, chr(10)) as text,
       cast(case when m.bad is null or p.ls is null then 0 else len(p.ls) - len(list_filter(p.ls, lambda x: not list_contains(m.bad, x))) end as int) as dropped_lines
from p left join m on p.host = m.host
"""
