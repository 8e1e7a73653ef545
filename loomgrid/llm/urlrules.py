"""URL filters: pattern rules indexed by their rarest literal token.

Every rule compiles to one regular expression over ``host + path``. Of the literal tokens (runs of letters and digits)
that each text matching it must hold whole, the one that is rarest among the judged URLs keys the rule in an index. A URL
looks up its own tokens and runs only the regular expressions found; rules without such a token run for every URL.
Token frequencies are counted over all URLs, for the rules' tokens only, so their number is bounded by the rules.
No URL is shuffled; a host that a third of all rows share costs nothing more.

Defined edge cases: null URLs and those without ``://`` have an empty host and path and fit no rule; rows are judged one
by one, so repeated rows repeat; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9]+"
#: Host and path of a URL; A-Z of the host are lower-cased afterwards.
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@dataclass(frozen=True)
class Rule:
    """``host/path`` fits a host with its subdomains and a path prefix; with ``pattern``, ``^`` stands for a separator or either end and ``*`` for anything."""

    verdict: str
    text: str
    pattern: bool = False

    @property
    def regex(self) -> str:
        if self.pattern:
            return "".join({"^": r"(?:^|[^A-Za-z0-9%]|$)", "*": ".*"}.get(c, re.escape(c)) for c in self.text)
        host, slash, path = self.text.partition("/")
        return rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path) if slash else '(?:/|$)'}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand whole in whatever the rule fits."""
        if self.pattern:
            found = re.finditer(TOKEN, self.text)
            return [m[0] for m in found if self.text[m.start() - 1 : m.start()] not in ("", "*") and self.text[m.end() : m.end() + 1] not in ("", "*")]
        found = list(re.finditer(TOKEN, self.text))
        open_end = "/" in self.text and found and found[-1].end() == len(self.text)
        return [m[0] for m in (found[:-1] if open_end else found)]


#: Addresses that carry advertisements, tracking or unwanted matter; applied where no given rule fits.
DEFAULT_PATTERNS = tuple(Rule("block", f"^{x}^", True) for x in ("ads", "adserver", "adtrack", "banner", "casino", "doubleclick", "malware", "phishing", "porn", "popup", "tracker", "xxx"))


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def token_counts(urls: DataFrame, url: str, rules) -> dict[str, int]:
    """In how many URLs each token of the rules stands."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = F.array_distinct(F.regexp_extract_all(F.concat(host_of(F.col(url)), path_of(F.col(url))), F.lit(TOKEN), F.lit(0)))
    kept = urls.select(F.explode(F.array_intersect(found, F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in kept.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest token, and those of rules without a token."""
    index: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if tokens := r.tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge(pages: DataFrame, rules, patterns=DEFAULT_PATTERNS, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict, n_candidates for every row.

    The longest fitting rule (ties: the earliest) gives rule and verdict. Where none fits, rule is null and the first
    fitting pattern gives the verdict, or ``otherwise`` stands.
    """
    every = [*rules, *patterns]
    index, always = build_index(every, token_counts(pages, url, every))
    n = len(rules)
    order = sorted(range(len(every)), key=lambda i: (i >= n, -len(every[i].text) if i < n else 0, i))
    rank = {i: k for k, i in enumerate(order)}
    texts, regexes, verdicts = [r.text for r in every], [r.regex for r in every], [r.verdict for r in every]

    def each(batches):
        compiled: dict[int, re.Pattern] = {}
        token, split = re.compile(TOKEN), re.compile(SPLIT)
        for batch in batches:
            out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": [], "n_candidates": []}
            for u in batch.column("url_").to_pylist():
                m = split.match(u or "")
                host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
                target, best = host + path, None
                found = {i for t in set(token.findall(target)) for i in index.get(t, ())} | set(always) if m else ()
                for i in sorted(found, key=rank.__getitem__):
                    if i not in compiled:
                        compiled[i] = re.compile(regexes[i], re.DOTALL)
                    if compiled[i].search(target):
                        best = i
                        break
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(texts[best] if best is not None and best < n else None)
                out["verdict"].append(otherwise if best is None else verdicts[best])
                out["n_candidates"].append(len(found))
            arrays = [batch.column("key_"), *(pa.array(out[c], pa.string()) for c in ("host", "path", "rule", "verdict")), pa.array(out["n_candidates"], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "host", "path", "rule", "verdict", "n_candidates"])

    kind = pages.schema[key].dataType.simpleString()
    slim = pages.select(F.col(key).alias("key_"), F.col(url).alias("url_"))
    return slim.mapInArrow(each, f"`{key}` {kind}, host string, path string, rule string, verdict string, n_candidates int")
