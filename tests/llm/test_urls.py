import itertools
import math
import random
import re

import numpy as np

from ledgerlens.llm import urls

WORDS = ["the", "then", "he", "end", "tion", "ble", "station", "stat", "on", "blue", "sky", "a"]


def plain_split(label, counts, total):
    """Best of all ways to cut a short label."""
    best = None
    for cuts in itertools.product([0, 1], repeat=max(0, len(label) - 1)):
        words, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                words.append(label[start:i])
                start = i
        score = 0.0
        for w in words:
            seen = counts.get(w)
            score += (math.log(seen) if seen else -math.log(urls.UNKNOWN) * len(w)) - math.log(total)
        best = max(best, score) if best is not None else score
    return best


def test_viterbi_finds_the_best_split():
    rng = random.Random(3)
    for _ in range(60):
        counts = {w: rng.randint(1, 500) for w in WORDS if rng.random() < 0.8} or {"a": 1}
        total = sum(counts.values())
        label = "".join(rng.choice(WORDS + ["x", "q7"]) for _ in range(rng.randint(1, 4)))[:12]
        words = urls.best_split(label, {w: math.log(n) for w, n in counts.items()}, total)
        assert "".join(words) == label
        score = sum(
            (math.log(counts[w]) if w in counts else -math.log(urls.UNKNOWN) * len(w)) - math.log(total)
            for w in words
        )
        assert abs(score - plain_split(label, counts, total)) < 1e-9


def test_long_words_and_labels_are_split(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    label = "k" * 300 + long + "station" + long + "x"
    labels = spark.createDataFrame([(label,), ("q",), (long,), (long[:25],)], "label string")
    words = [(long, 9), ("station", 50), (long[:21], 2), ("k" * 70, 3), ("other" * 30, 4), (long[:20] + "z", 5)]
    words = spark.createDataFrame(words, "word string, n long")
    pieces = {(r["label"], r["word"]) for r in urls.pieces_of(labels, words).collect()}
    table = [r["word"] for r in words.collect()]
    assert pieces == {(r["label"], w) for r in labels.collect() for w in table if w in r["label"]}
    got = {r["label"]: r["tokens"] for r in urls.segmented(labels, words).collect()}
    assert got[label][-4:] == [long, "station", long, "x"] and "".join(got[label]) == label
    assert got["q"] == ["q"] and got[long] == [long] and got[long[:25]] == [long[:21], long[21:25]]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [
        (len(r), r, v) for r, v in urls.RULES
        if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
        and path.startswith(r[r.index("/") :])
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.net/x", "http://net/", "http://net", "http://a.net?x=/", "x://www.example.net/en/1",
    "https://example.net/en", "https://EXAMPLE.com/de/#a", "http://example.com.evil/de/", "org/fr/",
    "http://a.org/fr/2?b", "http://a.org/de/2", "", None, "://", "http://ünïcode.org/ß", "a\n://b.net/\nc",
    "http://x.com/a://b/c", "http://" + "k" * 3000 + ".com/" + "p" * 5000, "http://thestation.com/blue-sky/12",
    "http://notnet/", "HTTP://ÄB.NET/",
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_parts_and_rules_match_plain_python(spark):
    rows = [(i, u, "<p>the station on the blue sky</p>") for i, u in enumerate(URLS)]
    rows += [(None, "http://a.net/x", None), (3, URLS[3], ""), (3, URLS[3], "")]
    frame = pages(spark, rows)
    for name in ("score", "tokens", "word", "label", "host"):
        frame = frame.withColumn(name, frame["html"])
    found = urls.judge(frame).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found if r["page_id"] is not None}
    for i, u, _ in rows[: len(URLS)]:
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        r = by[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0 else "allow")), u
    assert by[18]["tokens"][:3] == ["the", "station", "com"]


def test_bayes_matches_plain_counts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host = rng.choice(["bluesky", "theend", "stationon"]) + rng.choice([".net", ".org", ".com"])
        rows.append((i, f"http://{host}/{rng.choice(['fr', 'en', 'de'])}/{rng.choice(WORDS)}/{i}", "<b>" + " ".join(WORDS) + "</b>"))
    found = urls.judge(pages(spark, rows)).collect()
    counts = {"block": {}, "allow": {}}
    docs = {"block": 0, "allow": 0}
    tokens = lambda r: list(r["tokens"] or []) + urls.path_tokens(r["path"])
    for r in found:
        if r["rule"]:
            docs[r["verdict"]] += 1
            for t in tokens(r):
                own = counts[r["verdict"]]
                own[urls.slot(t)] = own.get(urls.slot(t), 0) + 1
    used = len(set(counts["block"]) | set(counts["allow"]))
    total = {v: sum(c.values()) for v, c in counts.items()}
    for r in found:
        score = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        for t in tokens(r):
            p = {v: (c.get(urls.slot(t), 0) + 1) / (total[v] + used) for v, c in counts.items()}
            score += math.log(p["block"] / p["allow"])
        assert np.isclose(score, r["score"])
    assert 0 < sum(r["rule"] is None for r in found) < 300


def test_empty_table(spark):
    assert urls.judge(pages(spark, [])).count() == 0
