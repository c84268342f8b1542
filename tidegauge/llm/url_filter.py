"""URL filters whose pattern rules are indexed by their rarest literal token.

A rule is a pattern over ``host + path`` with a verdict and a priority. Each rule lists the
literal tokens (runs of a-z, A-Z, 0-9 and non-ASCII letters between delimiters) that every
URL it fits must contain whole; the rule is filed under the one that the fewest URLs of the
table contain. A URL's own tokens fetch the candidate rules, and only those run their regular
expressions. Rules without a whole token are candidates for every URL.

The index is a literal hash table inside the projection (an array of buckets, reached by
``xxhash64(token)``), so URLs are judged where they lie: no join, no shuffle. It enters the plan
as one constant, read from JSON when the plan is made, so its size costs no analysis. It is meant
for rule lists of up to ``MAX_RULES``; the list is a parameter, not data, and its size is checked.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule and the
default verdict; rules that tie in length are ordered by host length and then by name;
repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
MAX_RULES = 100_000
#: What separates tokens: every ASCII character but letters and digits.
DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression over host + path; ``tokens`` its whole literal tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False
    rank: int = 0


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(DELIMITERS, text) if t]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", text)


def site_rule(verdict: str, spec: str) -> Rule:
    """A rule such as ``example.com/en/``: the host and all subdomains, paths that start so.

    A path token counts only if the spec closes it, as the URL's token may be longer.
    """
    host, slash, path = spec.partition("/")
    path = slash + path
    closed = path[: max((m.end() for m in re.finditer(DELIMITERS, path)), default=0)]
    return Rule(
        spec,
        verdict,
        rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}",
        tuple(dict.fromkeys([*_tokens(host), *_tokens(closed)])),
        True,
        len(spec) * 1000 + len(host),
    )


def host_word_rule(word: str) -> Rule:
    """Blocks hosts of which one label is ``word`` (labels split at dots)."""
    return Rule(f"||{word}^", BLOCK, rf"^(?:[^/]*\.)?{_quoted(word)}(?:[.:/]|$)", tuple(_tokens(word)))


#: The list of the query, fixed values.
SITE_RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)
#: Host labels of link farms and pill shops, blocked where no site rule fits.
BLOCKED_LABELS = ("spam-farm", "cheap-pills", "casino", "free-money", "adult-chat")


def default_rules() -> list[Rule]:
    return [site_rule(*x) for x in SITE_RULES] + [host_word_rule(w) for w in BLOCKED_LABELS]


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, F.lit(" "), path), DELIMITERS), lambda t: t != ""))


def token_frequencies(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many of all URLs (columns host, path) each of the rules' tokens stands."""
    if not tokens:
        return {}
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = found.join(F.broadcast(wanted), "token").groupBy("token").count().collect()
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in counts}


_RULE = "struct<token:string,listed:boolean,rank:bigint,name:string,verdict:string,pattern:string>"


def _fields(token: str, rule: Rule) -> dict:
    return {"token": token, "listed": rule.listed, "rank": rule.rank, "name": rule.name, "verdict": rule.verdict, "pattern": rule.pattern}


def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def judge(urls: DataFrame, rules: list[Rule], default: str = ALLOW) -> DataFrame:
    """``urls`` (with columns host, path) plus rule (a site rule's name or null) and verdict.

    The longest site rule that fits wins; without one a pattern rule blocks; else ``default``. Columns of
    ``urls`` called rule, verdict, tokens_ or best_ are replaced; rename them before.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index in the plan is meant for {MAX_RULES}")
    spark = urls.sparkSession
    often = token_frequencies(urls, sorted({t for r in rules for t in r.tokens}))
    filed = [(min(r.tokens, key=lambda t: (often[t], t)), r) for r in rules if r.tokens]
    loose = [("", r) for r in rules if not r.tokens]
    n = max(1, 1 << (len(filed) - 1).bit_length()) if filed else 1
    place = {}
    if filed:
        keys = spark.createDataFrame([(t,) for t in sorted({t for t, _ in filed})], "token string")
        place = {r["token"]: r["b"] for r in keys.select("token", F.pmod(F.xxhash64("token"), F.lit(n)).alias("b")).collect()}
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for token, rule in filed:
        buckets[place[token]].append(_fields(token, rule))
    index = _constant(buckets, f"array<array<{_RULE}>>")
    everywhere = _constant([_fields("", r) for _, r in loose], f"array<{_RULE}>")

    def fetched(token: Column) -> Column:
        return F.filter(F.element_at(index, (F.pmod(F.xxhash64(token), F.lit(n)) + 1).cast("int")), lambda r: r["token"] == token)

    text = F.concat("host", "path")
    candidates = F.concat(F.flatten(F.transform("tokens_", fetched)), everywhere)
    fits = F.filter(candidates, lambda r: F.regexp_like(text, r["pattern"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(*[r[c].alias(c) for c in ("listed", "rank", "name", "verdict")])))
    return (
        urls.withColumn("tokens_", url_tokens(F.col("host"), F.col("path")))
        .withColumn("best_", best)
        .withColumn("rule", F.expr("if(best_.listed, best_.name, null)"))
        .withColumn("verdict", F.coalesce("best_.verdict", F.lit(default)))
        .drop("tokens_", "best_")
    )


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = split_url(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return judge(urls, default_rules() if rules is None else rules)
