"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over `host path`. From the expression follow
literals that any match must hold, for each of its alternatives; their runs of
`TOKEN` characters are its tokens, `^` standing for the start of the host. An
alternative is indexed by that token of its own which the fewest rules have. A
URL's tokens fetch candidate rules, and only those run (and compile) their
expression. A rule without a literal that long is a candidate of every URL; none
of the rules given here is.

Host and path rules (a domain with its subdomains, a prefix of the path) decide by
the longest rule; where none fits, pattern rules decide: block where one that
blocks matches, else allow.

Rules come as a list or as text, one to a line (parse_rules): `allow host/path`,
`block host/path`, either with `*` for any characters of its part, or
`block /expression/`; `#` begins a comment. A rule that cannot be read raises
ValueError with its line. Rules travel in slices of at most `slice`; each slice is
one more scan of the URLs, whatever the number of rules.

Defined results: null urls and urls without :// have an empty host and path, no
rule, and are allowed; ties in length go to the rule given first; repeated rows
are judged each by itself; an empty table gives an empty result; without rules all
is allowed; ids may have any type; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice
from re import _constants as code
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Characters of a token.
TOKEN = 3
_MOST_ALTERNATIVES = 256


@dataclass(frozen=True)
class Rule:
    """pattern: over host, a blank, path. rank: the larger wins; 0: a pattern rule."""

    name: str
    verdict: str
    pattern: str
    rank: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """The host and its subdomains, paths that start with `path`; `*` stands for any characters."""
    any_ = lambda text: r"[^ ]*".join(re.escape(part) for part in text.split("*"))
    if "*" in host + path:
        return Rule(host + path, verdict, f"^{any_(host)} {any_(path)}")
    return Rule(host + path, verdict, rf"^(?:[^ ]*\.)?{any_(host)} {any_(path)}", len(host + path))


def parse_rules(lines: Iterable[str]) -> Iterator[Rule]:
    """Rules of a rule file, in order."""
    for k, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        verdict, _, body = text.partition(" ")
        body = body.strip()
        if verdict not in ("allow", "block") or not body:
            raise ValueError(f"rule {k} is neither allow nor block with a pattern: {text!r}")
        if len(body) > 2 and body[0] == body[-1] == "/":
            try:
                parser.parse(body[1:-1])
            except re.error as e:
                raise ValueError(f"rule {k} is no expression: {e}") from e
            yield Rule(body, verdict, body[1:-1])
        else:
            host, slash, path = body.partition("/")
            yield host_rule(verdict, host.lower(), slash + path)


def read_rules(spark: SparkSession, path: str) -> Iterator[Rule]:
    """Rules of a text file in any store that Spark reads; one partition of lines is in memory at a time."""
    return parse_rules(r.value for r in spark.read.text(path).toLocalIterator())


RULES_TEXT = r"""
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
# Words of hosts that sell, bet, show or track.
block /^(?:[^ ]*[.-])?(?:cheap|buy|online)-pills?[.-]/
block /^(?:[^ ]*[.-])?free-bets?[.-]/
block /^(?:[^ ]*[.-])?casinos?[0-9]*[.-]/
block /^(?:[^ ]*[.-])?(?:xxx|porn)[0-9]*\./
block /^(?:ads?|track|pixel)\.[^ ]+ /
block /^(?:[^ ]*[.-])?(?:spam|link)-farms?[.-]/
# Pages that hold no text of their own.
block */wp-login.php
block */cgi-bin/
block /\.(?:exe|apk|torrent)\Z/
"""
RULES = tuple(parse_rules(RULES_TEXT.split("\n")))


# ---------------------------------------------------------------- tokens of expressions

State = tuple[tuple[str, ...], str]


def _closed(states: list[State]) -> list[State]:
    return list(dict.fromkeys(((*runs, now) if now else runs, "") for runs, now in states))


def _follow(items: Iterable, states: list[State]) -> list[State]:
    """Literal runs of every alternative after the items; an alternative is its closed runs and the open one."""
    for op, value in items:
        if op is code.LITERAL:
            states = [(runs, now + chr(value)) for runs, now in states]
        elif op is code.AT:
            if value in (code.AT_BEGINNING, code.AT_BEGINNING_STRING):
                states = [(runs, "^") for runs, _ in _closed(states)]
        elif op is code.BRANCH:
            states = [s for part in value[1] for s in _follow(part, states)]
        elif op is code.IN and len(value) <= 4 and all(o is code.LITERAL for o, _ in value):
            states = [(runs, now + chr(v)) for _, v in value for runs, now in states]
        elif op is code.SUBPATTERN:
            states = _closed(states) if value[1] & re.IGNORECASE else _follow(value[3], states)
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            least, most, inner = value
            if (least, most) == (0, 1):
                states = states + _follow(inner, states)
            else:
                states = _closed(_follow(inner, states)) if least else _closed(states)
        elif op not in (code.ASSERT, code.ASSERT_NOT):
            states = _closed(states)
        if len(states) > _MOST_ALTERNATIVES:
            states = _closed([((), "")])
    return states


@cache
def tokens(pattern: str) -> tuple[frozenset[str], ...]:
    """For each alternative of an expression the tokens that its matches hold; an empty set where there are none."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return (frozenset(),)
    runs = (set(r) for r, _ in _closed(_follow(parsed, [((), "")])))
    return tuple({frozenset(x[i : i + TOKEN] for x in own for i in range(len(x) - TOKEN + 1)) for own in runs})


def index_rules(rules: Iterable[Rule]) -> tuple[dict[str, list[int]], list[int], list[Rule]]:
    """Places of rules by the rarest token of each alternative, places of those that have an alternative without one, and the rules."""
    rules = list(rules)
    often = Counter(t for r in rules for t in frozenset().union(*tokens(r.pattern)))
    by: dict[str, list[int]] = {}
    rest = []
    for k, r in enumerate(rules):
        if all(tokens(r.pattern)):
            for t in {min(sorted(own), key=lambda t: often[t]) for own in tokens(r.pattern)}:
                by.setdefault(t, []).append(k)
        else:
            rest.append(k)
    return by, rest, rules


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, path; empty without ://."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class Filter:
    """Rules ready to judge urls; an expression is compiled when a URL first fetches it."""

    def __init__(self, rules: Iterable[Rule]):
        self.by, self.rest, self.rules = index_rules(rules)
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, host: str, path: str) -> set[int]:
        text = f"^{host} {path}"
        grams = {text[i : i + TOKEN] for i in range(len(text) - TOKEN + 1)}
        return {k for g in grams for k in self.by.get(g, ())}.union(self.rest)

    def fits(self, host: str, path: str) -> Iterator[Rule]:
        """Rules that match, in order."""
        for k in sorted(self.candidates(host, path)):
            if k not in self.compiled:
                self.compiled[k] = re.compile(self.rules[k].pattern, re.S)
            if self.compiled[k].search(f"{host} {path}"):
                yield self.rules[k]

    def judge(self, host: str, path: str, state: tuple[int, str | None, str | None, bool] = (0, None, None, False)) -> tuple[int, str | None, str | None, bool]:
        """Rank, name and verdict of the best host rule so far, and whether a pattern blocks."""
        rank, name, said, blocked = state
        for r in self.fits(host, path) if host or path else ():
            if r.rank > rank:
                rank, name, said = r.rank, r.name, r.verdict
            blocked = blocked or (not r.rank and r.verdict == "block")
        return rank, name, said, blocked


_STATE = "rank int, rule string, said string, blocked boolean"


def _judge(batches: Iterator[pa.RecordBatch], own: Filter) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, host, path, rank, rule, said, blocked) brought up to date by one slice of rules."""
    for batch in batches:
        host, path, *state = (batch.column(k).to_pylist() for k in range(1, 7))
        rows = [own.judge(h, p, s) for h, p, *s in zip(host, path, *state, strict=True)]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=batch.schema.names)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)]], names=["page_id", "host", "path"])


def _first(batches: Iterator[pa.RecordBatch], own: Filter) -> Iterator[pa.RecordBatch]:
    for batch in _split(batches):
        n = len(batch)
        state = [pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array([False] * n)]
        yield from _judge(iter([pa.RecordBatch.from_arrays([*batch.columns, *state], names=["page_id", "host", "path", "rank", "rule", "said", "blocked"])]), own)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[Rule] = RULES, slice_: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, {_STATE}"
    df, whole, last = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), iter(rules), None
    while (part := list(islice(whole, slice_))) or last is None:
        if last is not None:
            df = materialize(df, "urls")
            last.unpersist()
        step, last = _judge if last is not None else _first, spark.sparkContext.broadcast(part)
        df = df.mapInArrow(lambda it, step=step, part=last: step(it, Filter(part.value)), schema)
    return df.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
