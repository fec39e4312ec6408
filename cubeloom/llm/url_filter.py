"""URL filters: a weighted vocabulary searched by Aho-Corasick.

One automaton holds all terms; a pass over the whole url finds every
occurrence.  An occurrence counts only between boundaries (no ASCII letter or
digit on either side).  A URL is rejected on one strict term or on
``soft_limit`` distinct soft terms.  Rules by host and path prefix come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of our own: terms that reject alone, and terms of which several reject.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "adult", "phishing", "malware", "warez", "escort")
SOFT_TERMS = ("ads", "bets", "cheap", "deal", "farm", "free", "gambling", "loan", "pills", "poker", "promo", "spam", "track", "win")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict) of the registered query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def vocabulary(table: DataFrame, most: int = 100_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a table with term and weight (2 or more: strict, 1: soft); refused beyond ``most`` terms."""
    rows = table.where("term is not null and term <> '' and weight >= 1").select(F.translate("term", UPPER, LOWER).alias("term"), "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    strict = {r.term for r in rows if r.weight >= 2}
    return tuple(sorted(strict)), tuple(sorted({r.term for r in rows} - strict))


def build_automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for term in terms:
            automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def _inside(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def term_hits(text: str, automaton) -> tuple[int, int]:
    """(distinct strict, distinct soft) terms that stand between boundaries in a lower-case text."""
    found = {value for end, value in automaton.iter(text) if not _inside(text, end + 1) and not _inside(text, end - len(value[0]))}
    strict = sum(w for _, w in found)
    return strict, len(found) - strict


def url_parts(url: str) -> tuple:
    """(host, path) columns.  Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: then up to ``?``, ``#`` or the end.  Null or no ``://``: both empty."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def url_filter(pages: DataFrame, rules: tuple = RULES, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, soft_limit: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins and its name is in ``rule``.  Otherwise the vocabulary
    decides on the whole url, A-Z lower-cased.  Null and empty URLs have empty
    parts and are allowed; very long ones are read whole; repeated rows are
    judged each; ties between rules of one length go to the first in order of
    host and path; extra columns are ignored; an empty table gives none.
    """
    host, path = url_parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER).alias("whole"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(strict, soft)
        for f in frames:
            hits = [term_hits(u, automaton) for u in f["whole"]]
            yield f.drop(columns="whole").assign(strict_hits=[a for a, _ in hits], soft_hits=[b for _, b in hits])

    found = rows.mapInPandas(scan, "page_id long, host string, path string, strict_hits long, soft_hits long")
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("strict_hits") >= 1) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    # the last one that fits is taken: short rules first, and of one length the first by name last
    for h, p, v in sorted(sorted(rules, reverse=True), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_hits")


def oracle() -> str:
    """The registered query in DuckDB SQL."""
    hit = lambda terms: " + ".join(f"cast(regexp_matches(lower_all, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as int)" for t in terms)
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    return f"""
with cut as (
  select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as lower_all,
         case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, lower_all, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
hits as (
  select page_id, host, path, {hit(STRICT_TERMS)} as strict_hits, {hit(SOFT_TERMS)} as soft_hits
  from parts)
select page_id, host, path,
  case {" ".join(f"when {fits(h, p)} then '{h + p}'" for h, p, _ in order)} end as rule,
  case {" ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in order)} when strict_hits >= 1 or soft_hits >= 2 then 'block' else 'allow' end as verdict,
  cast(strict_hits as bigint) as strict_hits, cast(soft_hits as bigint) as soft_hits
from hits"""
