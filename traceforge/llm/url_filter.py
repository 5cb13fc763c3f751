"""URL rules indexed by their rarest literal token; columns and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

# Rules are a parameter written into the plan, so their number is bounded.
MOST_RULES = 2_000
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest one wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> set[str]:
        """Tokens that any URL it fits must hold: its host's labels and its whole path segments."""
        labels = [t for label in self.host.split(".") for t in _split(label)]
        *whole, _ = self.path.split("/")
        return {*labels, *(t for segment in whole for t in _split(segment))}


@dataclass(frozen=True)
class PatternRule:
    """Fits where ``pattern`` is found in host and path; every such URL holds the ``literals`` as tokens."""

    verdict: str
    name: str
    pattern: str
    literals: tuple[str, ...]

    def tokens(self) -> set[str]:
        return set(self.literals)


def _split(text: str) -> list[str]:
    return [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]


def _words(name: str, *literals: str) -> PatternRule:
    """Block a sequence of words joined by a hyphen, dot, underscore or nothing between them at the host's or path's marks."""
    return PatternRule(BLOCK, name, r"(^|[^a-z0-9])" + "[-._]".join(literals) + r"([^a-z0-9]|$)", literals)


SITE_RULES = [
    SiteRule(ALLOW, "org", "/"),
    SiteRule(BLOCK, "example.org", "/es/"),
    SiteRule(BLOCK, "example.org", "/en/1"),
    SiteRule(ALLOW, "com", "/fr/"),
    SiteRule(BLOCK, "com", "/de/"),
]
PATTERN_RULES = [
    _words("pills", "cheap", "pills"),
    _words("pharmacy", "online", "pharmacy"),
    _words("spam farm", "spam", "farm"),
    _words("link farm", "link", "farm"),
    _words("free money", "free", "money"),
    _words("payday loans", "payday", "loans"),
    _words("casino", "casino"),
    _words("poker", "poker"),
    _words("betting", "betting"),
    _words("porn", "porn"),
    _words("xxx", "xxx"),
    _words("sex", "sex"),
    _words("escort", "escort"),
    _words("warez", "warez"),
    _words("torrent", "torrent"),
    _words("crack", "crack", "download"),
    _words("essay mill", "buy", "essay"),
    _words("followers", "buy", "followers"),
    PatternRule(BLOCK, "numbered login", r"/login/[0-9]+/?$", ("login",)),
    PatternRule(BLOCK, "cart", r"/(cart|basket)/checkout(/|$)", ("checkout",)),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def _tokens(host: Column, path: Column) -> Column:
    address = lower_ascii(F.concat(host, F.lit(" "), path))
    return F.array_distinct(F.regexp_extract_all(address, F.lit("([a-z0-9]+)"), F.lit(1)))


def _index(urls: DataFrame, rules: list) -> dict[str, list[int]]:
    """Positions of rules by the one of their tokens that is in the fewest URLs, ties by spelling."""
    wanted = sorted({t for rule in rules for t in rule.tokens()})
    counts = {t: 0 for t in wanted}
    token = urls.select(F.explode(F.filter("tokens", lambda t: t.isin(wanted))).alias("token"))
    counts.update((r["token"], r["n"]) for r in token.groupBy("token").agg(F.count("*").alias("n")).collect())
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        index.setdefault(min(rule.tokens(), key=lambda t: (counts[t], t)), []).append(i)
    return index


def judge(
    pages: DataFrame,
    kept: list[Column],
    site_rules: list[SiteRule] = SITE_RULES,
    pattern_rules: list[PatternRule] = PATTERN_RULES,
) -> DataFrame:
    """``kept`` columns, host, path, rule, verdict and pattern of every row's ``url``.

    A URL's tokens fetch the rules indexed under them; only those are tested,
    the patterns by regular expression. The longest fitting site rule decides;
    without one, ``pattern`` is the first fitting pattern rule in the order
    given and decides; without that the verdict is allow. A null URL or one
    without ``://`` has empty host and path. Nothing is shuffled but the counts
    of the rules' own tokens.
    """
    rules = [*site_rules, *pattern_rules]
    if len(rules) > MOST_RULES or not all(rule.tokens() for rule in rules):
        raise ValueError(f"at most {MOST_RULES} rules, each with a literal token")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct(*kept).alias("kept"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", _tokens(F.col("host"), F.col("path")))
    entries = [
        F.struct(F.lit(token).alias("token"), F.array(*map(F.lit, at)).alias("at"))
        for token, at in sorted(_index(rows, rules).items())
    ]
    fetched = F.flatten(F.filter(F.transform("tokens", _lookup(entries)), lambda at: at.isNotNull()))
    rows = rows.withColumn("fetched", F.array_sort(F.array_distinct(fetched))).withColumn(
        "address", lower_ascii(F.concat("host", "path"))
    )
    sites = [
        F.struct(
            F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")
        )
        for r in site_rules
    ]
    patterns = [
        F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
        for r in pattern_rules
    ]
    n = len(site_rules)

    def fits_site(rule: Column) -> Column:
        of_host = (F.col("host") == rule["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), rule["host"]))
        return of_host & F.startswith(F.col("path"), rule["path"])

    def of(at: Column, structs: list[Column], offset: int) -> Column:
        return F.element_at(F.array(*structs), at - offset + 1)

    empty = F.lit(None)
    site, pattern = empty, empty
    if sites:
        fitting = F.filter(
            F.transform(F.filter("fetched", lambda i: i < n), lambda i: of(i, sites, 0)), fits_site
        )
        site = F.reduce(
            fitting,
            F.struct(F.lit("").alias("name"), F.lit("").alias("verdict")),
            lambda best, r: F.when(
                F.length(r["name"]) > F.length(best["name"]), F.struct(r["name"].alias("name"), r["verdict"].alias("verdict"))
            ).otherwise(best),
        )
    if patterns:
        pattern = F.get(
            F.filter(
                F.transform(F.filter("fetched", lambda i: i >= n), lambda i: of(i, patterns, n)),
                lambda r: F.rlike(F.col("address"), r["pattern"]),
            ),
            F.lit(0),
        )
    rows = rows.select("kept", "host", "path", site.alias("site"), pattern.alias("pattern"))
    rule = F.nullif(F.col("site.name"), F.lit("")) if sites else F.lit(None).cast("string")
    found = F.col("pattern.name") if patterns else F.lit(None).cast("string")
    own = F.col("pattern.verdict") if patterns else F.lit(None).cast("string")
    verdict = F.when(rule.isNotNull(), F.col("site.verdict")) if sites else F.lit(None).cast("string")
    return rows.select(
        "kept.*",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, own, F.lit(ALLOW)).alias("verdict"),
        F.when(rule.isNull(), found).alias("pattern"),
    )


def _lookup(entries: list[Column]):
    index = F.map_from_entries(F.array(*entries))
    return lambda token: F.try_element_at(index, token)
