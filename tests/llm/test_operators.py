"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesseral.llm import decontaminate, langid, lm, minhash, mixing, pii, quality, tokens, urls, warc
from tesseral.llm.common import crc32_of_id, materialize, split_by, stored
from tesseral.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, node long, h long"


def make(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, lang, s, False, 7, 7) for i, t, lang, s in rows], SCHEMA).repartition(3)


def texts(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("tho", "Rin", "éa", "ção", "sh") for b in ("re", "Ond", "ß", "ly", "nt", "x")]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 160))) for _ in range(n)]
    out = [None, "", " \n\t ", "one", "Two words", "a b c d e", "x" * 30_000, "word " * 6_000]
    for b in base:
        out.append(b)
        if rng.random() < 0.5:
            w = b.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        if rng.random() < 0.2:
            out.append(b)
    return [(k, t, ["en", "fr", None][k % 3], [None, "s1", "s2", "S3"][k % 4]) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).cache()


def sets(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    own = {i: sets(t) for i, t, *_ in rows}
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in ids}


def test_near_duplicates(docs, rows):
    want = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_of_families(spark):
    """A family whose members are similar in a chain, a large one that is not, and a passage that many share."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    base, out = rng.sample(words, 120), []
    for k in range(60):
        w = list(base)
        for _ in range(k % 13):
            w[rng.randrange(120)] = rng.choice(words)
        out.append(" ".join(w))
    chain = rng.sample(words, 150)
    for k in range(15):
        chain[k * 9 : k * 9 + 2] = rng.sample(words, 2)
        out.append(" ".join(chain))
    shared = rng.sample(words, 60)
    out += [" ".join([*rng.sample(words, 25), *shared, *rng.sample(words, 25)]) for _ in range(40)]
    rows = [(k, t, None, None) for k, t in enumerate(out)]
    hot = minhash.Params(pairs=8, side=16, block=8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(spark, rows), params=hot).collect()}
    assert got == components(rows)


def test_near_duplicates_edges(spark):
    rows = [(5, "a b c d e f", None, None), (5, "a b c d e f", None, None), (3, "a b c d e f", None, None), (None, "a b c d e f", None, None), (9, None, None, None), (8, "", None, None), (9, "other words", None, None), (2, "other WORDS", None, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(spark, rows)).collect())
    assert got == [(False, 2, 1, 2, True), (False, 3, 2, 3, True), (False, 5, 2, 3, False), (False, 5, 2, 3, False), (False, 8, 0, 8, True), (False, 9, 0, 9, True), (False, 9, 1, 2, False), (True, 0, 2, None, True)]
    assert minhash.near_duplicates(make(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_split_keeps_what_joins(spark):
    rows = spark.range(0, 5000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), F.col("id").alias("__place2"))
    wanted = spark.range(0, 5000, 11).select(F.col("id").alias("w"))
    near, others = split_by(rows, "k", wanted, "w")
    assert near.count() + others.count() == 5000 and near.count() < 600
    assert others.join(wanted, F.col("k") == F.col("w")).count() == 0 and others.where("k is null").count() == 715
    assert split_by(rows, "k", wanted.limit(0), "w")[0].count() == 0


def test_stored_tables_are_removed(spark):
    with stored(spark) as keep_outer:
        with stored(spark) as keep:
            a, b = (materialize(spark.range(n), "t") for n in (3, 4))
            keep(a)
        assert a.count() == 3 and not os.path.exists(b._stored_path)
        c = materialize(spark.range(5), "t")
        keep_outer(c)
    assert c.count() == 5 and not os.path.exists(a._stored_path)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(m):
    d = [int(x) for x in re.sub("[^0-9]", "", m)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    n = lambda m: len(re.sub("[^0-9]", "", m))
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= n(m) <= 19 and luhn(m), "phone": lambda m: 9 <= n(m) <= 15}
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if good[k](m[0])] for k, p in KINDS.items()}


PERSONAL = [
    None, "", "mail a@b.c_d@e.f and x..y@z.co.uk.", "a@b @c.d e@f.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "41111111111111111111111 4111111111111111-1",
    "é😀 +1 (415) 555-0100 😀 +49.30.1234567890123456 +12", "+1 415 555 0100+44 20 7946 0958", "iban DE89 3704 0044 0532 0130 00 now, DE89370400440532013001", "ssn 078-05-1120, other 078-05-1120", "x" * 20_000 + "@" + "y" * 10 + ".z", "1" * 20_000, "1 " * 5_000, "a@b.c " * 300,
]


def test_personal_data(spark):
    rng = random.Random(5)
    many = ["".join(rng.choices("0123456789.+- @ab(é", k=rng.randint(5, 60))) for _ in range(400)]
    rows = [(k, t, None, None) for k, t in enumerate(PERSONAL + many)]
    for r in pii.find_personal_data(make(spark, rows)).collect():
        want = base_spans(rows[r.doc_id][1])
        assert r.base_spans == ",".join(x for k in KINDS for x in want[k]), rows[r.doc_id][1]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in KINDS]
    got = {r.doc_id: r for r in pii.find_personal_data(make(spark, rows[: len(PERSONAL)])).collect()}
    assert (got[9].n_iban, got[10].n_nid) == (1, 1)
    assert got[9].spans.endswith("iban:5:32")
    clean = {r.doc_id: r.text for r in pii.redact(make(spark, rows[: len(PERSONAL)])).collect()}
    assert clean[0] is None and clean[5].startswith("[CARD] and 4111") and clean[8] == "[PHONE][PHONE]" and "[IBAN]" in clean[9]
    assert pii.redact(make(spark, [])).count() == 0


def mixed(x):
    """The finaliser of splitmix64 on a Python number."""
    x &= 2**64 - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
    return x ^ (x >> 31)


def numbers(n, key):
    return [mixed((k + 1 + (key << 20)) * 0x9E3779B97F4A7C15) for k in range(n)]


SYMBOL = numbers(256, 7)


def hashed(word):
    return mixed(sum(SYMBOL[b + 32 if 65 <= b <= 90 else b] * pow(6364136223846793005, k, 2**64) for k, b in enumerate(word.encode())))


def plain_score(text, model, counts, p):
    """The model's log10 probability of a text, word by word."""
    end = int(lm.END)
    words = WORD.findall((text or "").translate(LOWER))
    ending = lambda w: int.from_bytes(w.encode()[-3:].rjust(3, b"\0"), "big")
    tokens = [hashed(w) for w in words] + [end]
    kinds = [int(model.class_of[1 + mixed(ending(w) + 77) % (p.kinds - 1)]) for w in words] + [0]
    salt, total = numbers(3, 41), 0.0
    for i, (word, kind) in enumerate(zip([*words, None], kinds, strict=True)):
        back = lambda x, k, i=i: x[i - k] if i >= k else 0
        trio = [kinds[i - k] + 1 if i >= k else 0 for k in (1, 2, 3)]
        keys = back(tokens, 1), back(tokens, 2), trio[0] * 4096 + trio[1] * 64 + trio[2]
        z = [float(x) for x in model.prior]
        for key, s in zip(keys, salt, strict=True):
            row = model.weights[mixed(key ^ s) % len(model.weights)]
            z = [a + float(b) for a, b in zip(z, row, strict=True)]
        top = max(z)
        total += (z[kind] - top) / math.log(10) - math.log10(sum(math.exp(x - top) for x in z))
        total += math.log10(counts[word] + 1) - float(model.log_total[kind])
    return total


def test_language_model(docs, rows):
    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(7)) == 2
    p = lm.Params(frequent=20)
    model = lm.fit(docs.where(~held), F.col("text"), p)
    got = lm.score(docs, model, F.col("doc_id"), held, F.col("text"), p).collect()
    bags = {i: Counter([*WORD.findall((t or "").translate(LOWER)), None]) for i, t, *_ in rows}
    text = {i: t for i, t, *_ in rows}
    counts = Counter()
    for r in got:
        if not r.held_out:
            counts.update(bags[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        bag = bags[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (sum(bag.values()), n, sum(k for w, k in bag.items() if counts[w]))
        assert math.isclose(r.base_score, sum(k * math.log10((counts[w] + 1) / (n + v + 1)) for w, k in bag.items()), rel_tol=1e-9)
        if r.n_tokens < 300:
            assert math.isclose(r.score, plain_score(text[r.doc_id], model, counts, p), rel_tol=1e-4)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language_model_is_a_distribution(spark):
    """After any history the known words and one unknown word of each class have probabilities that sum to 1."""
    base = [(k, "the cat sat on the mat the dog ran" if k % 2 else "der hund lief auf den baum der hund", None, None) for k in range(40)]
    p = lm.Params(frequent=4, classes=8)
    model = lm.fit(make(spark, base), F.col("text"), p)
    counts = Counter(w for _, t, *_ in base for w in [*t.split(), None])
    kind = lambda w: int(model.class_of[1 + mixed(int.from_bytes(w.encode()[-3:].rjust(3, b"\0"), "big") + 77) % (p.kinds - 1)]) if w else 0
    own = Counter()
    for w, c in counts.items():
        own[kind(w)] += c + 1
    for k in range(p.classes):
        seen, n = own[k], 10 ** float(model.log_total[k])
        # A class without the end keeps room for one unknown word.
        assert math.isclose(seen + (k > 0), n, rel_tol=1e-9)
    known = {r.doc_id: r.score for r in lm.score(make(spark, [(0, "the cat", None, None), (1, "der cat", None, None)]), model, F.col("doc_id"), F.lit(False), F.col("text"), p).collect()}
    assert known[0] > known[1]


def test_language_model_learns_from_all(spark):
    """Classes and counts are the same however rows lie; the table of features grows with the words."""
    rows = [(k, " ".join(f"w{(k * 31 + j * 7) % 900}x" for j in range(60)), None, None) for k in range(200)]
    one, two = (lm.fit(make(spark, rows).repartition(n), F.col("text"), lm.Params(least_rows=16, share=4)) for n in (1, 5))
    assert (one.class_of == two.class_of).all() and (one.tokens, one.types) == (two.tokens, two.types)
    assert len(one.weights) == 128 and len(lm.fit(make(spark, rows[:2]), F.col("text"), lm.Params(least_rows=16, share=4)).weights) < 128


def test_language_model_edges(spark):
    empty = make(spark, [])
    model = lm.fit(empty, F.col("text"))
    assert model.tokens == 0 and lm.score(empty, model, F.col("doc_id"), F.lit(True), F.col("text")).count() == 0
    one = lm.score(make(spark, [(None, None, None, None)]), model, F.col("doc_id"), F.lit(True), F.col("text")).first()
    assert (one.n_tokens, one.n_known, one.base_score) == (1, 0, 0.0)


URLS = [
    None, "", "no scheme", "http://", "https://Sub.Example.ORG/es/1", "https://notexample.org/es/1", "https://example.org/en/12?x", "https://example.org", "http://a.com/de/#f", "http://a.com/fr/x?u=http://b.org/de/", "http://www.cheap-pills.example.com/en/", "http://x.free-bets.net/", "ftp://h?q", "a://b://c/d", "http://com/de/",
    "http://example.org:80/es/",
]


def test_urls(spark):
    rows = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(rows).collect()}
    given = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    for k, u in enumerate(URLS):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m and (u or "").index("://") == m.start() else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if k in (10, 11) else "allow")
        assert got[k] == (host, path, rule, verdict), u
    again = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(rows, slice_=2).collect()}
    assert again == got
    assert {r.verdict for r in urls.filter_urls(rows, rules=[]).collect()} == {"allow"}
    twice = urls.filter_urls(rows.unionByName(rows)).collect()
    assert len(twice) == 2 * len(URLS) and all(got[r.page_id] == (r.host, r.path, r.rule, r.verdict) for r in twice)
    assert urls.filter_urls(rows.limit(0)).count() == 0
    named = urls.filter_urls(rows.select(F.concat(F.lit("p"), "page_id").alias("page_id"), "url"))
    assert named.schema["page_id"].dataType.simpleString() == "string" and named.count() == len(URLS)


def test_rule_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# hosts\nblock Bad.com/\nallow bad.com/good/\nblock *.shop.net/sale*\n\nblock /[?]nothing|^evil\\./\n")
    given = list(urls.read_rules(spark, str(tmp_path / "rules.txt")))
    own = urls.Filter(given)
    said = {u: own.judge(*urls.split_url(u)) for u in ("http://a.bad.com/x", "http://bad.com/good/y", "http://a.shop.net/sales/1", "http://shop.net/sale", "http://evil.org/", "http://devil.org/")}
    assert [x[2] for x in said.values()] == ["block", "allow", None, None, None, None]
    assert [x[3] for x in said.values()] == [False, False, True, False, True, False]
    for bad in ("deny a/", "block", "block /(/"):
        with pytest.raises(ValueError):
            list(urls.parse_rules([bad]))


def test_url_index_finds_every_match():
    """Every rule given has a token for each alternative, and whatever a rule matches is a candidate by tokens alone."""
    own = urls.Filter(urls.RULES)
    assert not own.rest
    rng = random.Random(6)
    parts = ["org", "example.org", "com", "cheap-pill.", "buy-pills-", "free-bet.", "casinos12.", "xxx.", "ads.", "track.", "spam-farm.", "x", "a.b"]
    paths = ["/", "/es/", "/en/12", "/fr/", "/de/x", "/wp-login.php", "/cgi-bin/q", "/a.exe", "/a.exe/b", ""]
    met = set()
    for _ in range(3000):
        host, path = "".join(rng.choices(parts, k=rng.randint(1, 3))), rng.choice(paths)
        fits = {k for k, r in enumerate(own.rules) if re.search(r.pattern, f"{host} {path}", re.S)}
        assert fits <= own.candidates(host, path), (host, path)
        met |= fits
    assert met == set(range(len(own.rules)))
    odd = ["a(?i:BC)d", "ab?cd", "(?:abc|xy)+z", "[ab]cd|efg", "x.y", "^abc", "(abc){2,}", "a*"]
    mixed_ = urls.Filter([urls.Rule(o, "block", o) for o in odd])
    assert {mixed_.rules[k].name for k in mixed_.rest} == {"a(?i:BC)d", "x.y", "a*", "(?:abc|xy)+z"} - {o for o in odd if all(urls.tokens(o))}
    for _ in range(3000):
        text = "".join(rng.choices("abcdxyzefgBC", k=8))
        assert {k for k, r in enumerate(mixed_.rules) if re.search(r.pattern, f"{text} ")} <= mixed_.candidates(text, "")


def rules(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, cover, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover.update(range(i, i + 8))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_rules(spark, rows):
    extra = ["a\n\na\nb\n a\na", "|".join("abc"), "é ß\u2003x\n", "a b c d e f g h " * 5, "\n", "x\n" * 50, "line one\nline one", "a\r\na\r\n"]
    whole = [*rows, *[(1000 + k, t, None, None) for k, t in enumerate(extra)]]
    got = quality.judge(make(spark, whole), quality.fit(make(spark, whole), quality.trusted_ids(spark.createDataFrame([], "doc_id long, quality int, toxic int"), "doc_id", quality.Params()))).collect()
    by = {i: t for i, t, *_ in whole}
    assert len(got) == len(whole)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(by[r.doc_id]), by[r.doc_id]
        assert r.kept == (not r.base_failed)


def test_quality_ratio(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 8))) for _ in range(300)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(100)]
    bad = [" ".join(w + rng.choice(["***", "###", "&&&"]) for w in rng.choices(words, k=80)) for _ in range(100)]
    rows = [(k, t, None, None) for k, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(k, int(k < 100), 0) for k in range(0, 200, 4)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    ratio = quality.fit(docs, quality.trusted_ids(labels, "doc_id", quality.Params()))
    kept = {r.doc_id: r.kept for r in quality.judge(docs, ratio).collect()}
    assert all(kept[k] == (k < 100) for k in range(200))
    left = quality.keep_good(docs, ratio)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(100))


def plain_ratio(trusted, every, p):
    """Mean log ratio and tail of a text, n-gram by n-gram."""
    mult = [(x | 1) % 2**32 for x in numbers(p.n, 21)]

    def fine(t):
        data, out = (t or "").encode(), []
        for i in range(len(data) - p.n + 1):
            code = sum(b * m for b, m in zip(data[i : i + p.n], mult, strict=True)) % 2**32
            code = (code ^ (code >> 15)) * 0x2C1B3C6D % 2**32
            out.append((code >> 8) % p.fine)
        return out

    good, raw = (Counter(b for t in own for b in fine(t)) for own in (trusted, every))
    total = {id(c): sum(c.values()) for c in (good, raw)}
    lacks = {b for b, n in raw.items() if good[b] + 1 < math.exp(p.tail_ratio) * total[id(good)] * n / total[id(raw)]}
    wide = {id(c): Counter() for c in (good, raw)}
    for c in (good, raw):
        for b, n in c.items():
            wide[id(c)][b % p.buckets] += n
    share = lambda c, b: (wide[id(c)][b] + p.smoothing) / (total[id(c)] + p.smoothing * p.buckets)
    ratio = {b: math.log(share(good, b) / share(raw, b)) for b in wide[id(raw)]}

    def judged(t):
        own = fine(t)
        return (sum(ratio[b % p.buckets] for b in own) / len(own), sum(b in lacks for b in own) / len(own)) if own else (0.0, 0.0)

    return judged


def test_quality_verdicts(spark):
    """kept by a plain loop over n-grams, on texts of all sizes, whatever their neighbours; a few words that no trusted text has."""
    rng = random.Random(8)
    texts_ = [" ".join(rng.choices(["tion", "the", "ing", "of"], k=rng.randint(0, 60))) for _ in range(40)] + ["#" * 90, "$ % " * 40, "", None, "abc", "é" * 30]
    texts_ += [" ".join(rng.choices(["tion", "the", "ing", "of"], k=50)) + " wretched" * k for k in (0, 1, 3, 9) for _ in range(3)]
    rows = [(k, t, None, None) for k, t in enumerate(texts_)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 40)] + [(41, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    p = quality.Params(threshold=-0.3, smoothing=0.01, tail_share=0.01)
    docs = make(spark, rows)
    model = quality.fit(docs, quality.trusted_ids(labels, "doc_id", p), params=p)
    plain = plain_ratio([texts_[k] for k in range(40)], texts_, p)
    got = quality.judge(docs, model, params=p).collect()
    for r in got:
        score, tail = plain(texts_[r.doc_id])
        assert abs(r.score - score) < 2e-6 and abs(r.tail - tail) < 2e-6
        assert r.kept == (not r.base_failed and r.score >= p.threshold and r.tail <= p.tail_share)
    by = {r.doc_id: r for r in got}
    assert any(by[k].kept for k in range(40)) and all(by[k].tail > 0.01 and not by[k].kept for k in range(52, 58))
    alone = quality.judge(docs.where("doc_id = 40"), model, params=p).first()
    assert alone == by[40]


def test_ids_of_any_type(spark):
    """Text ids pass where nothing is made of them but themselves."""
    docs = spark.createDataFrame([("a", "word " * 30), ("b", None), (None, "x")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int")
    trusted = quality.trusted_ids(labels, "doc_id", quality.Params())
    assert len(trusted) == 1
    assert {r.doc_id for r in quality.judge(docs, quality.fit(docs, trusted)).collect()} == {"a", "b", None}
    assert {r.doc_id for r in tokens.token_lengths(docs).collect()} == {"a", "b", None}
    bench = spark.createDataFrame([(1, "word " * 9)], "item_id long, text string")
    assert {(r.doc_id, r.n_items) for r in decontaminate.contamination(docs, bench).collect()} == {("a", 1), ("b", 0), (None, 0)}


def test_mixing(spark, rows):
    docs = make(spark, [*rows, *rows[:5], (None, "no id here", None, "s1")])
    got = mixing.plan_mix(docs).collect()
    again = mixing.plan_mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.copies, r["size"], tuple(r.shards))
    assert sorted(map(key, got)) == sorted(map(key, again))
    size = Counter()
    for r in got:
        size[r.source] += r["size"]
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        full.update(over)
    target = {s: 2 * size[s] if s in full else level * weight[s] for s in names}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.copies <= 2 and len(r.shards) == r.copies
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r["size"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    drawn = mixing.mix(docs)
    assert drawn.columns[: len(docs.columns)] == docs.columns
    empty = make(spark, [])
    assert mixing.plan_mix(empty).count() == 0 and mixing.plan_mix(make(spark, [(1, None, None, "a")])).first().copies == 0


def test_mixing_shards_are_even(spark):
    docs = make(spark, [(k, "word " * 10, None, f"s{k % 3}") for k in range(3000)])
    shards = Counter(s for r in mixing.plan_mix(docs).collect() for s in r.shards)
    assert len(shards) == 16 and max(shards.values()) < 2 * min(shards.values())


def test_splitting_tree_keeps_quotas(spark):
    """Every source's quota is dealt out whole, every shard gets its half of halves, by packs of few sources."""
    quotas = {f"s{k}": (k * 37) % 23 + (900 if k == 5 else 0) + 1 for k in range(60)}
    frame = spark.createDataFrame(list(quotas.items()), "name string, quota long")
    p = mixing.Params(pack=7, levels=3)
    got = {r.name: list(r.shares) for r in mixing.shard_quotas(frame, p).collect()}
    assert got == {r.name: list(r.shares) for r in mixing.shard_quotas(frame.repartition(3), p).collect()}
    assert {k: sum(v) for k, v in got.items()} == quotas and all(min(v) >= 0 and len(v) == 8 for v in got.values())
    sizes = [sum(quotas.values())]
    for _ in range(3):
        sizes = [x for n in sizes for x in (n // 2, n - n // 2)]
    assert [sum(v[k] for v in got.values()) for k in range(8)] == sizes
    # The hot source's share of each shard has the spread of draws without replacement, not of an even deal.
    assert len(set(got["s5"])) > 1 and max(got["s5"]) < 2 * min(got["s5"])
    assert mixing.shard_quotas(frame.limit(0), p).count() == 0


def test_mixing_draws_are_disjoint(spark):
    """A document drawn twice stands in two draws of its block; copies and shards are one thing."""
    docs = make(spark, [(k, "word " * (k % 7 + 1), None, f"s{k % 5}" if k % 3 else "hot") for k in range(2000)])
    plan = mixing.plan_mix(docs).collect()
    drawn = mixing.mix(docs).select("doc_id", "mix_copy", "mix_shard", "mix_place").collect()
    assert sorted((r.doc_id, k + 1, s) for r in plan for k, s in enumerate(r.shards)) == sorted((r.doc_id, r.mix_copy, r.mix_shard) for r in drawn)
    assert len({r.mix_place for r in drawn}) == len(drawn) and {r.mix_shard for r in drawn} == set(range(16))


def test_mixing_ranks_many_sources(spark):
    names = [f"d{(k * 7919) % 5003:05d}" for k in range(5000)]
    docs = make(spark, [(k, "a b c", None, n) for k, n in enumerate(names)])
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(sorted(set(names)))}
    got = {r.source: r.target for r in mixing.plan_mix(docs).collect()}
    top = max(got.values())
    assert all(math.isclose(t, {3: top, 1: min(got.values()), 2: 2 * min(got.values())}[weight[n]], rel_tol=1e-9) for n, t in got.items())
    assert math.isclose(sum(got.values()), 1.5 * 15_000, rel_tol=1e-9)


def test_token_counts(docs, rows):
    enc = tokens.encoder(tokens.Params())
    lengths = [len(enc.encode_ordinary(t)) if t else 0 for _, t, *_ in rows]
    hist = tokens.length_histogram(tokens.token_lengths(docs))
    got = {r.n_tokens: r for r in hist.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.docs == lengths.count(n) and r.docs_over == sum(x > n for x in lengths)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.total_tokens == sum(lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
    for r in tokens.at_limits(hist, [0, 10, 77, 10**6]).collect():
        assert (r.docs_over, r.truncated_tokens) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    assert tokens.quantile(hist, 0.5) == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    none = tokens.length_histogram(tokens.token_lengths(docs.limit(0)))
    assert none.count() == 0 and tokens.quantile(none, 0.5) is None and tokens.at_limits(none, [3]).count() == 0


def test_language(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "and", "ing", "tion", "of"], "de": ["der", "ung", "sch", "keit", "ß"], "fr": ["le", "eau", "é", "ment", "ç"]}
    rows = [(k, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(40)), lang, None) for k, lang in enumerate(list(parts) * 40)]
    docs = make(spark, [*rows, (900, None, "en", None), (901, "12 !? \n", "en", None), (902, "Äß über", None, None), (None, "the and", "en", None)])
    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1
    profiles = langid.fit(docs.where(~held), F.col("lang"), F.col("text"))
    got = {r.doc_id: r for r in langid.predict(docs, profiles, F.col("doc_id"), held, F.col("text")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert (got[900].lang_pred, got[901].lang_pred) == ("und", "und") and got[902].lang_pred == "de"
    assert langid.predict(docs, {}, F.col("doc_id"), held, F.col("text")).where("lang_pred != 'und'").count() == 0


def plain_grams(t):
    """n-grams of one to three characters, blanks at the ends only."""
    out = Counter()
    for run in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
        whole = f" {run} "
        out.update(run)
        out.update(whole[i : i + 2] for i in range(len(whole) - 1))
        out.update(whole[i : i + 3] for i in range(len(whole) - 2))
    return out


def code_of(g):
    value = 0
    for c in g:
        value = value << 21 | ord(c)
    return value


def top_grams(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code_of(x[0])))[:most]]


def plain_language(t, profiles, most):
    own = top_grams(plain_grams(t), most)
    if not own or not profiles:
        return "und", 0.0
    apart = {lang: sum(abs(place[g] - k) if g in place else most for k, g in enumerate(own)) for lang, place in profiles.items()}
    best = min(sorted(apart), key=lambda x: apart[x])
    return best, 1 - apart[best] / (most * len(own))


def test_language_by_hand(spark):
    """Profiles, distances and scores recounted; ties in counts and in distance, repeated rows, odd letters, no rows."""
    rng = random.Random(9)
    odd = [None, "", "12 !?", "a", "b", "ab ab ba", "Straße ÄÖ", "x" * 3000, "日本 語 text", "é e\u0301 É", "İI ıi"]
    rows = [(k, t, "zz" if k % 2 else "aa", None) for k, t in enumerate(odd)]
    rows += [(100 + k, " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 80))), rng.choice(["aa", "bb", "zz", None]), None) for k in range(60)]
    rows += rows[-5:]
    p = langid.Params(most=40, salts=3)
    docs = make(spark, rows)
    counts = {}
    for _, t, lang, _ in rows:
        if lang is not None and t is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    want = {lang: {g: k for k, g in enumerate(top_grams(c, p.most))} for lang, c in counts.items()}
    profiles = langid.fit(docs, F.col("lang"), F.col("text"), p)
    assert {lang: list(map(int, codes)) for lang, codes in profiles.items()} == {lang: [code_of(g) for g in place] for lang, place in want.items()}
    got = langid.predict(docs, profiles, F.col("doc_id"), F.lit(True), F.col("text"), p).collect()
    by = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        lang, score = plain_language(by[r.doc_id], want, p.most)
        assert r.lang_pred == lang and math.isclose(r.score, score, abs_tol=1e-12), by[r.doc_id]
    empty = make(spark, [])
    assert langid.fit(empty, F.col("lang"), F.col("text")) == {} and langid.predict(empty, profiles, F.col("doc_id"), F.lit(True), F.col("text")).count() == 0
    # Equal profiles: the language first in order.
    same = {"n": profiles["aa"], "m": profiles["aa"]}
    assert langid.predict(docs, dict(sorted(same.items())), F.col("doc_id"), F.lit(True), F.col("text"), p).where("lang_pred = 'n'").count() == 0


def hits(t, windows):
    w = ITEM.findall((t or "").translate(LOWER))
    hit, items = set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                hit.update(range(k, k + n))
                items |= own
    return len(w), len(hit), items


@pytest.mark.parametrize("slice_", [1_000_000, 3])
def test_decontamination(spark, rows, slice_):
    long = next(t for _, t, *_ in rows if t and len(t.split()) > 60)
    bench = [(1, long), (2, "One"), (3, None), (4, "..."), (5, long.upper()), (12, "Two-words"), (None, "x y")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    windows = {}
    for i, t in bench:
        w = ITEM.findall((t or "").translate(LOWER))
        n = min(8, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    p = decontaminate.Params(slice=slice_)
    docs = make(spark, [*rows[:30], (500, f"start {long} end", None, None), (501, "and one, two (words) here", None, None)])
    by = {i: t for i, t, *_ in rows} | {500: f"start {long} end", 501: "and one, two (words) here"}
    for r in decontaminate.contamination(docs, table, params=p).collect():
        n, hit, items = hits(by[r.doc_id], windows)
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (n, hit, len(items), ",".join(sorted(map(str, items))), len(items) >= 2)
    left = {r.doc_id for r in decontaminate.decontaminate(docs, table, params=p).collect()}
    full = {w: own for w, own in windows.items() if len(w) == 8}
    assert left == {i for i in (r.doc_id for r in docs.collect()) if not hits(by[i], full)[1] and len(hits(by[i], windows)[2]) < 2}
    assert 500 not in left and 501 not in left
    once = make(spark, [(1, "just One word", None, None), (2, f"x {long}", None, None)])
    assert [r.doc_id for r in decontaminate.decontaminate(once, table, params=p).collect()] == [1]
    assert decontaminate.decontaminate(docs, table, params=p).columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, table, params=decontaminate.Params(items=99, slice=slice_), drop=False).collect()}
    assert cut[501] == "and ,  () here"
    assert decontaminate.contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(make(spark, []), table).count() == 0


def test_archives(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "http://a b/\n", big), (2, None, None), (3, "http://c", big), (4, "http://d", ""), (5, "u", other), (6, "u", "small"), (7, "u", "small"), (8, "u", big), (8, "u", big), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 90)]
    pages = spark.createDataFrame([(a, b, c, "z") for a, b, c in rows], "page_id long, url string, html string, key string").repartition(2)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, params=warc.Params(archive=2000)).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [x for x, _, h in rows if h == html and x is not None]
        old = i is not None and len(data) >= 1000 and i < max(same)
        want.append((i is None, i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", max(same) if old else None))
    assert got == sorted(want, key=lambda x: x[:2])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_join_beyond_the_bound(spark):
    pages = spark.createDataFrame([(k, "u", "y" * 1200 + str(k % 4)) for k in range(40)], "page_id long, url string, html string")
    same = [{(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages, params=p).collect()} for p in (warc.Params(), warc.Params(most=0, archive=9000, group=2500, version=2))]
    assert same[0] == same[1] and len(same[0]) == 40 and sum(x[1] == "revisit" for x in same[0]) == 36


def test_archives_that_are_damaged_fail():
    record = warc.arc_to_warc(next(warc.read_arc(warc.write_arc([("http://a", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\npay\r\n\r\nload")]))))

    def back(data):
        reader = warc.Reader()
        return [warc.read_record(*found) for piece in data.split(b"\r\n\r\n") if (found := reader.take(piece))]

    assert back(record)[0][1:4] == (11, hashlib.sha1(b"pay\r\n\r\nload").hexdigest(), "response")
    for bad in (record.replace(b"\r\nload", b"\r\nlead"), record.replace(b"\r\nload", b"\r\nloaded"), b"x" + record):
        with pytest.raises(ValueError):
            back(bad)
    assert back(record[:-3]) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\n\nfiledesc://x 1 2\n"), ("http://b", "20200102030405", "text/plain", b"")]
    whole = warc.write_arc(records, version)
    back = list(warc.read_arc(whole))
    assert [(r.fields["URL"], r.fields["Archive-date"], r.fields["Content-type"], r.block) for r in back] == records
    heads, block = next(warc.read_warc(warc.arc_to_warc(back[0])))
    assert (heads["warc-date"], block) == ("2020-01-02T03:04:05Z", records[0][3])
    cut = whole.index(b"http://b")
    packed = gzip.compress(whole[:cut]) + gzip.compress(whole[cut:])
    assert list(warc.read_arc(packed)) == back
    for bad in (b"filedesc://x 0 0 t 9\nno", whole[:-30]):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_legacy_archives(spark, tmp_path):
    """Blanks in a content type, Latin-1 and blanks in a URL, carriage returns, short dates, bad lines and lengths, broken gzip."""
    body = b"1 0 old\nURL IP-address Archive-date Content-type Archive-length\n"
    head = b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(body) + body + b"\n"
    good = [b"http://caf\xe9.fr/ 1.2.3.4 19970102 text/html; charset=latin 1 5\nhello\n", b"http://a b/c 1.2.3.4 19970102030405 text/html 3\r\nabc\r\n", b"dns:x 1.2.3.4 19970102030405 no-type 2\nok\n"]
    bad = [b"this is no header\n", b"http://long 1.2.3.4 19970102030405 text/html 99999\nxyz\n"]
    data = head + good[0] + bad[0] + good[1] + bad[1] + good[2]
    noted = []
    assert [r.block for r in warc.read_arc(data, noted)] == [b"hello", b"abc", b"ok"]
    assert {reason.split(" ")[0] for _, reason in noted} == {"header", "record"} and len(noted) == 3
    (tmp_path / "a.arc").write_bytes(data)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(head + good[0]) + gzip.compress(good[1])[:-4])
    rows = warc.read_arc_files(spark, str(tmp_path)).collect()
    assert sorted(r.url for r in rows if r.error is None) == sorted(["http://café.fr/", "http://a b/c", "dns:x", "http://café.fr/", "http://a b/c"])
    assert {r.content_type for r in rows if r.url == "http://café.fr/"} == {"text/html; charset=latin 1"}
    assert sum(r.error is not None for r in rows) == 3
    with pytest.raises(ValueError):
        list(warc.read_arc(data))


@pytest.mark.parametrize("number", [0, 1, -1, 2**63 - 1, -(2**63), 123456789])
def test_record_ids(number):
    assert warc.record_number(warc.record_id(number)) == number
