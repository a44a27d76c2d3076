"""URL filtering: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
#: Terms, that count where they stand alone between characters that are neither ASCII letters nor digits. A strict one
#: rejects a URL.
STRICT = (
    "adult", "bangbros", "blowjob", "bukkake", "camgirl", "camgirls", "casino", "casinos", "chaturbate", "cialis", "erotic", "erotica", "escort", "escorts", "fetish", "gambling", "gangbang", "hardcore", "hentai", "jackpot",
    "keygen", "levitra", "milf", "nsfw", "nude", "nudes", "onlyfans", "phishing", "porn", "porno", "pornhub", "pornography", "redtube", "roulette", "slots", "spam", "sportsbook", "torrent", "torrents", "viagra", "warez", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Soft ones by their weight: NEEDED distinct ones that weigh LIMIT together reject a URL.
SOFT = {
    3: ("ad", "ads", "click", "clicks", "coupon", "coupons", "deal", "deals", "discount", "farm", "free", "gift", "hot", "offer", "offers", "promo", "redirect", "sale", "singles", "track", "tracker", "tracking", "traffic", "trial", "vip", "win", "winner"),
    5: ("affiliate", "bet", "bets", "bingo", "bonus", "casinobonus", "cheap", "clickbait", "crack", "cracked", "crypto", "dating", "diet", "forex", "hookup", "loan", "loans", "lottery", "lotto", "payday", "pharmacy", "pills", "poker", "popunder", "popup", "replica", "serial", "sex", "sexy", "unlock", "webcam", "weightloss"),
}
NEEDED, LIMIT = 2, 6
#: (verdict, host, start of the path); a rule holds for its host and all hosts below it, and the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or where there is no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(FOLD), tail[:stop]


def vocabulary(strict=STRICT, soft=SOFT) -> tuple[tuple[str, int], ...]:
    """(term, weight) of all terms; a strict one has the weight 0."""
    return (*((t, w) for w, terms in soft.items() for t in terms), *((t, 0) for t in strict))


@lru_cache(4)
def _automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, weight in terms:
        a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def terms_in(url: str, terms: tuple[tuple[str, int], ...]) -> tuple[set[str], dict[str, int]]:
    """The distinct strict terms and the weights of the distinct soft ones that stand alone in ``url``."""
    low = url.translate(FOLD)
    word = LOWER + "0123456789"
    hard: set[str] = set()
    mild: dict[str, int] = {}
    for end, (term, weight) in _automaton(terms).iter(low):
        start = end - len(term)
        if (start < 0 or low[start] not in word) and (end + 1 == len(low) or low[end + 1] not in word):
            if weight:
                mild[term] = weight
            else:
                hard.add(term)
    return hard, mild


def _judge(rules, terms, needed, limit):
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        if host:
            by_host.setdefault(host, []).append((host + path, path, verdict))
    sizes = sorted({len(h) for h in by_host})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                hard, mild = terms_in(url or "", terms)
                weight = sum(mild.values())
                fits = []
                for n in sizes:  # only ends of the host that are as long as a rule's
                    if n == len(host) or n < len(host) and host[-n - 1] == ".":
                        fits += [(len(r), r, v) for r, p, v in by_host.get(host[-n:], ()) if path.startswith(p)]
                rule, verdict = max(fits)[1:] if fits else (None, "block" if hard or len(mild) >= needed and weight >= limit else "allow")
                rows.append((host, path, rule, verdict, len(hard), len(mild), weight))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols[:4]), *(pa.array(c, pa.int32()) for c in cols[4:])], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])

    return run


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, needed: int = NEEDED, limit: int = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight), a row for each row.

    Without a rule the vocabulary decides: block on one strict term, or on ``needed`` distinct soft ones that weigh
    ``limit`` together, else allow; a repeated term counts once. A null or empty URL is allowed; a null id stays null;
    repeated rows repeat; an empty table gives an empty one; other columns, whatever their names, are not looked at. No
    shuffle, and per-row work in proportion to the URL's length, whatever that is.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return own.mapInArrow(_judge(tuple(rules), vocabulary(strict, soft), needed, limit), "page_id bigint, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight int")


def oracle(strict=STRICT, soft=SOFT, needed: int = NEEDED, limit: int = LIMIT) -> str:
    """The production query in DuckDB's SQL."""
    alone = lambda t: f"regexp_matches(low, '(^|[^a-z0-9])({t})([^a-z0-9]|$)')"
    below = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {below(h)} AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in longest)
    words = ", ".join(f"('{t}', {w})" for w, terms in soft.items() for t in terms)
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, low, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
v AS (SELECT list(term) AS terms, map(list(term), list(weight)) AS weights FROM (VALUES {words}) t(term, weight)),
d AS (SELECT *, CASE {rule} END AS rule, {alone("|".join(strict))} AS hard, list_distinct(string_split_regex(low, '[^a-z0-9]+')) AS own,
  list_intersect(own, terms) AS hits, coalesce(list_sum(list_transform(hits, lambda t: weights[t])), 0) AS weight FROM c, v)
SELECT page_id, host, path, rule, CASE {verdict} WHEN hard OR len(hits) >= {needed} AND weight >= {limit} THEN 'block' ELSE 'allow' END AS verdict FROM d"""
