"""Chat views, quality rules, license scans and URL filters against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from passbook.llm import chat, divergence, licenses, queries, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


# Chat


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", None), (1, 2, "ann", "again"),
        (1, 2, "ann", "again"), (1, 3, None, "who?"), (None, 0, "cy", "lone"), (2, 0, "system", "only"),
    ]
    found = chat.perspectives(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, name string"))
    got = [tuple(r) for r in found.collect()]
    expected = []
    for conv in (1, None):
        turns = [r for r in rows if r[0] == conv]
        for view in {r[2] for r in turns if r[2] not in ("system", None)}:
            for _, turn, who, text in turns:
                role = "system" if who == "system" else "assistant" if who == view else "user"
                name = re.sub("[^A-Za-z0-9_-]", "_", who) if role == "user" and who is not None else None
                head = f"<|im_start|>{role}" + (f" name={name}" if name else "") + "\n"
                body = (text or "").replace("<|", "< |")
                mask = role == "assistant"
                span = (len(head), len(head) + len(body) + 10) if mask else (None, None)
                expected.append((conv, view, turn, who, role, name, head + body + "<|im_end|>\n", mask, *span))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert all(r[6][r[8] : r[9]].endswith("<|im_end|>") for r in got if r[7])


def test_perspectives_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.perspectives(empty).count() == 0


# Quality rules


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_counts():
    rng = random.Random(5)
    alphabet = ["a", "b", "cc", "É", "日本", "#", "x|y", "\n", "\n", " ", "\t", "\u00a0", "\x1c", "1,2"]
    texts = ["", " \n\t", "a", "a b c a b c", "a\x0bb\x0ca"] + [
        " ".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)
    ]
    for text in texts:
        assert divergence.measure(text.encode())[:5] == slow_base(text), repr(text)
    assert divergence.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_distance():
    reference = np.array([4.0, 4.0, 2.0])
    assert divergence.distance(np.array([[2, 2, 1], [0, 0, 7], [0, 0, 0]]), reference)[0] == pytest.approx(0, abs=1e-7)

    def slow(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)

    found = divergence.distance(np.array([[1, 0, 5], [0, 0, 0]]), reference)
    assert found[0] == pytest.approx(slow([1, 0, 5], [4, 4, 2])) and math.isnan(found[1])


def english(rng, n):
    filler = ["stone", "river", "garden", "quiet", "lamp", "morning", "walked", "found", "paper", "window", "small", "green"]
    common = ["the", "of", "and", "to", "in", "a", "is"]
    words = [rng.choice(common) if rng.random() < 0.3 else rng.choice(filler) + rng.choice(filler) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def test_quality_rules(spark):
    rng = random.Random(1)
    rows = [(i, english(rng, 200), "en" if i % 4 else None, "s", 1) for i in range(40)]
    rows += [
        (100, english(rng, 200).upper().replace(" ", "!! "), "en", "s", 1),
        (101, " ".join(w + "###$$$" for w in english(rng, 200).split()), "en", "s", 1),
        (102, "same words here " * 60, "en", "s", 1),
        (103, "too short", "en", "s", 1), (104, None, "en", "s", 1), (105, "", None, None, None),
        (7, rows[7][1], "en", "s", 1), (None, rows[8][1], "xx", "s", 1),
        (106, english(rng, 50), "fr", "s", 1),
    ]
    table = docs(spark, rows)
    refs = divergence.references(divergence.measured(table))
    assert [r[0] for r in refs] == ["en", "fr"]
    kept = divergence.keep(table, refs)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(40), 7, None, 106])
    clash = table.withColumnRenamed("source", "n_words").withColumnRenamed("n_chars", "_row")
    assert divergence.keep(clash, refs).count() == 43
    nothing = table.limit(0)
    assert divergence.references(divergence.measured(nothing)) == [] and divergence.keep(nothing, []).count() == 0
    # Without references only the base rules decide.
    assert divergence.keep(table, []).count() == 45


def test_rules_of_long_text(spark):
    text = english(random.Random(2), 120_000)
    row = divergence.measured(docs(spark, [(1, text, "en", "s", 1)])).first()
    assert row.n_words == 120_000 and row.word_chars == len(text) - 119_999


# URL filters


def slow_judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        site, start = rule.split("/", 1)
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    if best:
        return host, path, best[1], best[2]
    spam = any(x in host.split(".")[:-1] for x in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track"))
    return host, path, None, "block" if spam else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://Example.NET", "http://example.net/", "http://example.net/en/1?x=/de/#/fr/",
    "https://a.example.com/de/5", "https://a.example.com/DE/5", "https://fexample.com/de/5", "http://x.org/fr/", "http://x.org/fr",
    "http://cheap-pills.example.com/en/", "http://example.com/cheap-pills/", "http://cheap-pills", "http://notnet/en", "x://net/en",
    "ftp://a://b.net/x", "http://ÄB.net/en/\nq", "http://casino-win.example.org/fr/9", "http://example.net:80/en/", "http://example.net?q=/en/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "other") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, rule string")
    found = {r.page_id: r for r in urls.judge(pages, queries.SITE_RULES + queries.WORD_RULES).collect()}
    for i, u in enumerate(URLS * 2):
        r = found[i]
        rule = r.rule if r.rule_rank == 1 else None
        assert (r.host, r.path, rule, r.verdict) == slow_judge(u), u
    assert urls.judge(pages.limit(0), queries.SITE_RULES).count() == 0
    free = [urls.Rule("digits", "block", "[0-9]{3}", ())]
    assert urls.judge(pages, free).filter("verdict = 'block'").count() == 0


def test_partial_token_is_no_literal():
    assert urls.site_rule("block", "a.com/de").literals == ("a", "com")
    assert urls.site_rule("block", "a.com/x/de/").literals == ("a", "com", "x", "de")


# Licenses


def slow_scan(text, templates, words=5):
    """Best containment of each template over all windows of its group's length."""
    clean = lambda t: [w for w in (x.strip(".,;:!?\"'()[]{}") for x in t.lower().split()) if w]
    gram = lambda ws: [tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)]
    out = {}
    mine = gram(clean(text))
    for name, template in templates.items():
        t = set(gram(clean(template)))
        size = 1 << (len(t) - 1).bit_length()
        for start in range(0, len(mine), size):
            share = len(t & set(mine[start : start + 2 * size])) / len(t)
            if share >= 0.8:
                out[name] = max(out.get(name, 0), share)
    return out


def test_license_scan(spark):
    rng = random.Random(3)
    names = list(licenses.TEMPLATES)
    rows = []
    for i in range(120):
        parts = english(rng, rng.randrange(0, 90)).split()
        for _ in range(rng.randrange(3)):
            notice = licenses.TEMPLATES[rng.choice(names)].split()
            if rng.random() < 0.4:
                notice[-1] = "changed"
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = notice
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "MIT License.", None, None, None)]
    got = {}
    for r in licenses.scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    for doc_id, text, *_ in rows:
        assert got.get(doc_id, {}) == pytest.approx(slow_scan(text or "", licenses.TEMPLATES)), text
    assert any(got.values()) and licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_license_position():
    found = licenses.Index(licenses.TEMPLATES, 5, 80).scan([b"one two three Released under the MIT License. four " * 3, None])
    assert found[0] == [("mit", 3, 1.0, 6)] and found[1] == []
