"""The ten operators against brute force on small fixtures with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.llm import (arrays, bpe_words, hash_forest, hilbert, html_text, ngram_join, packing, pii,
                            quality_cnn, quality_rules, url_filter)
from framescore.llm.queries import tokenizer_path

AWKWARD = [None, "", " ", "\n\n\t ", "a", "É", "x" * 30000, "word " * 3000, "don't 'tis we'll  \n 12³ 中文 𝒳!?",
           "one two three four five six seven", "A\x0bB\x0cC\rD", "same text here", "same text here"]


def _words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "eps", "zeta", "eta"]) + str(rng.randint(0, 60))
                    for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = AWKWARD + [_words(rng, rng.choice([3, 12, 60, 200])) for _ in range(60)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 5}", "own") for i, t in enumerate(texts)]
    rows += [(None, "null id text of five words or more", "en", None, "own"), rows[20], rows[20], rows[20]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, ids string"
                                 ).repartition(3)


def _empty(spark, df):
    return spark.createDataFrame([], df.schema)


def _rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- shared arrays

def test_pretokens_equal_the_pattern():
    import public_tokenizers
    import regex
    rng = random.Random(1)
    alpha = [*"ab'  \n\t.!19éß中𝒳\u2003\xa0٣stmdrevl", "'s", "'re", " '"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None]
    data, off = arrays.text_bytes(__import__("pyarrow").array(texts))
    starts = arrays.pretokens(data, off)
    ends, first, raw = np.append(starts[1:], len(data)), np.searchsorted(starts, off), data.tobytes()
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        got = [raw[starts[k]:ends[k]].decode() for k in range(first[i], first[i + 1])]
        assert got == pattern.findall(t or "")


def test_words_and_hashes():
    texts = ["a b\tc", "", "  x ", "A b"]
    data, off = arrays.text_bytes(__import__("pyarrow").array(texts))
    starts, ends, first = arrays.words_of(data, off)
    raw = data.tobytes()
    assert [raw[s:e] for s, e in zip(starts, ends, strict=True)] == [b"a", b"b", b"c", b"x", b"A", b"b"]
    assert first.tolist() == [0, 3, 3, 4, 6]
    h = arrays.hash_slices(data, starts, ends, fold=True)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4


# ---------------------------------------------------------------- 1 personal data

PII_TEXTS = [
    None, "", "mail a.b@c.de and a@b.c_d@e.f, x@y", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4",
    "card 4465758382889437 4465-7583 8288 9437 1 2", "call +1 (523) 555-1055, +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "é𝒳 mail: q@w.com +49 30 1234567.", "tel 523-555-1055 or write joe (at) example (dot) com", "9" * 3000,
    "a" * 50000, "1 " * 4000, ("x@y.zz " * 700) + "end", "4" + "0" * 14 + "2"]


def _pii_base(text):
    text = text or ""
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, p) in enumerate(patterns):
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))
                    or kind == "card" and not (14 <= len(d) <= 19 and doubled % 10 == 0)
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PII_TEXTS)] + [(None, "z@z.zz", 1)] * 2,
                               "doc_id bigint, text string, spans int")
    got = _rows(pii.contract(pii.find(df)))
    assert len(got) == len(PII_TEXTS) + 2
    for r in got:
        text = "z@z.zz" if r["doc_id"] is None else PII_TEXTS[r["doc_id"]]
        want = _pii_base(text)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[3] == k for w in want) for k in pii.KINDS]
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))
    assert _rows(pii.contract(pii.find(_empty(spark, df)))) == []


def test_pii_estimate_orders_reliable_labelers():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.6
        strict = int(true and rng.random() < 0.9)
        gaz = 1 if rng.random() < (0.9 if true else 0.1) else -1
        cue = int(rng.random() < (0.5 if true else 0.05))
        miss = -int(rng.random() < (0.02 if true else 0.3))
        variety = rng.choice([-1, 1])
        key = (0, (strict, gaz, cue, miss, variety))
        counts[key] = counts.get(key, 0) + 1
    weights, bias = pii.estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert weights[1] > 0.5 and abs(weights[4]) < 0.3 and weights[0] > 0.5


def _luhn_number(rng, first, n, valid=True):
    body = first + "".join(rng.choice("0123456789") for _ in range(n - len(first) - 1))
    for last in "0123456789":
        d = body + last
        if (sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0) == valid:
            return d
    raise AssertionError


def _made_personal(rng):
    """A text, and its personal (true) and harmless (false) pieces beyond the base patterns."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    num = lambda n: "".join(rng.choice("123456789") for _ in range(n))                                 # noqa: E731
    four = lambda d, sep: sep.join(d[i:i + 4] for i in range(0, len(d), 4))                              # noqa: E731
    tld = rng.choice(["com", "org", "net", "de", "info"])
    octet = lambda: str(rng.randint(1, 254))                                                             # noqa: E731
    true = [("email", f"{word()}.{word()} (at) {word()}.{tld}"), ("email", f"{word()} at {word()} dot {tld}"),
            ("email", f"{word()}[at]{word()}[dot]{tld}"), ("email", f"{word()} @ {word()}.{tld}"),
            ("ip", "[.]".join(octet() for _ in range(4))), ("ip", " . ".join(octet() for _ in range(4))),
            ("ip", ":".join(rng.choice(["20a1", "db8", "7", "ff02", "9c"]) for _ in range(8))),
            ("card", four(_luhn_number(rng, rng.choice(["4", "51", "6011"]), 16), rng.choice("./_"))),
            ("phone", f"({num(3)}) {num(3)}-{num(4)}"), ("phone", f"{num(3)}.{num(3)}.{num(4)}"),
            ("phone", f"0{num(2)} {num(4)} {num(4)}"), ("phone", f"0{num(3)}/{num(7)}")]
    false = [f"isbn 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{word()} @ {word()}. {word().title()}",
             f"{word()} @ {word()}. {word()}",
             f"version {rng.randint(1, 9)} . {rng.randint(0, 9)} . {rng.randint(300, 999)} . 4",
             f"order {four(_luhn_number(rng, '1', 16, valid=False), '.')}", f"no 0{rng.randint(1, 9)}.0{rng.randint(1, 9)}.20{num(2)}",
             f"serial {_luhn_number(rng, '9', 17, valid=False)}", f"part 0{num(2)}-{num(3)}-{num(2)}"]
    base = [f"{word()}@{word()}.{tld}", ".".join(octet() for _ in range(4)),
            four(_luhn_number(rng, "4", 16), " "), f"+49 {num(2)} {num(8)}"]
    cue = {"email": ["mail: ", "contact "], "ip": ["host ", "ip "], "card": ["card "], "phone": ["tel ", "phone: "]}
    pieces, wanted, text = [], [], ""
    for _ in range(3):
        kind = rng.choice(["true", "false", "base"])
        if kind == "true":
            what, s = rng.choice(true)
            pieces.append((what, (rng.choice(cue[what]) if rng.random() < 0.5 else word() + " "), s))
        else:
            pieces.append((None, word() + " ", rng.choice(false if kind == "false" else base)))
    for what, lead, s in pieces:
        text += " ".join(word() for _ in range(4)) + ", " + lead
        if what:
            wanted.append((what, len(text), len(text) + len(s)))
        text += s + " ; "
    return text, wanted


def test_pii_proposals_on_held_out_documents(spark):
    """Labelers learnt on made documents without labels, judged on others: spans beyond the base ones."""
    rng = random.Random(11)
    made = [_made_personal(rng) for _ in range(1500)]
    df = lambda part: spark.createDataFrame(list(enumerate(t for t, _ in part)), "doc_id bigint, text string")
    learnt = pii.train(pii.candidates(df(made[:1000])))
    held = made[1000:]
    rows = pii.candidates(df(held)).select("doc_id", pii._kept(*learnt).alias("spans")).collect()
    found = {(r["doc_id"], pii.KINDS[s["kind"]], s["start"], s["end"]) for r in rows for s in r["spans"] if not s["base"]}
    wanted = {(i, *w) for i, (_, want) in enumerate(held) for w in want}
    by_kind = {k: (len({f for f in found & wanted if f[1] == k}), len({f for f in found if f[1] == k}),
                   len({w for w in wanted if w[1] == k})) for k in pii.KINDS}
    precision, recall = len(found & wanted) / len(found), len(found & wanted) / len(wanted)
    print(f"precision {precision:.3f} recall {recall:.3f} (right, found, wanted): {by_kind}")
    assert precision >= 0.95 and recall >= 0.85, by_kind
    proposed = pii.candidates(df(held)).select(F.explode("found").alias("c")).filter("NOT c.base")
    votes = proposed.agg(*[F.countDistinct(f"c.{v}").alias(v) for v in pii.LABELERS]).first()
    # proposals are longer than five different characters here, so variety says the same of all
    assert all(votes[v] >= 2 for v in pii.LABELERS if v != "variety"), votes


def test_pii_redaction(spark):
    df = spark.createDataFrame([(0, "é a@b.cc x +1 (523) 555-1055!", 5), (1, None, 6), (None, "+49.30.123.45 678 z", 7)],
                               "doc_id bigint, text string, spans int")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r["spans"]: r["text"] for r in out.collect()} == {5: "é [email] x [phone]!", 6: None, 7: "[phone] z"}


# ---------------------------------------------------------------- 2 url filter

def _url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):]).group()
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def test_url_filter(spark):
    rng = random.Random(3)
    urls = [None, "", "http://", "no scheme.net/", "http://A.NET", "http://a.net/", "https://net/x?y=1&z#q", "x://y://b.net/",
            "http://example.net/en/1", "http://aexample.net/en/1", "http://sub.example.com/de/", "http://org/fr/", "http://b.org/fr"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['www', 'ads-track', 'blog', 'm'])}.{rng.choice(['example', 'foo'])}"
             f".{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 999)}?a=1" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://c.com/", "x")] * 2,
                               "page_id bigint, url string, host string")
    got = _rows(url_filter.judge(df))
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, best = _url(urls[r["page_id"]] if r["page_id"] is not None else "http://c.com/")
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    ads = [r["verdict"] for r in got if r["rule"] is None and "ads-track" in r["host"]]
    assert ads.count("block") >= 0.8 * len(ads)
    rest = [r["verdict"] for r in got if r["rule"] is None and ".foo.com" in r["host"] and "ads" not in r["host"]]
    assert rest.count("allow") >= 0.8 * len(rest)
    assert _rows(url_filter.judge(_empty(spark, df))) == []
    unlabelled = spark.createDataFrame([(1, "http://q.zz/a")], "page_id bigint, url string")
    assert _rows(url_filter.judge(unlabelled))[0]["verdict"] == "allow"


@pytest.mark.parametrize("bad,copies", [(6, 1), (1, 5), (3, 400)])
def test_url_filter_rare_kind(spark, bad, copies):
    """A kind of label that a uniform sample of the bound would miss, also as copies of few URLs."""
    urls = [(i, f"https://www.site{i % 50 + 10}.org/en/{i + 1000}") for i in range(4000)]
    urls += [(9000 + k, f"http://casino-{k}.spam{k}.biz/{k}?a=1") for k in range(bad) for _ in range(copies)]
    df = spark.createDataFrame(urls, "page_id bigint, url string").repartition(3)
    got = _rows(url_filter.judge(df, bound=100))
    assert len(got) == len(urls)
    assert all((r["verdict"] == "block") == (r["page_id"] >= 9000) for r in got)
    assert 0 < min(r["block_probability"] for r in got)                # the trees' own


@pytest.mark.parametrize("left_out", [("casino", "win"), ("pills",), ("nothing",), pytest.param(
    ("spam",), marks=pytest.mark.xfail(reason="open: free-bets, unlisted too and as long, counts as good: 12 of 23"))])
def test_url_filter_finds_words_not_listed(spark, left_out):
    """Hosts whose word is not in the list are judged by trees that did not learn their presumed label."""
    rng = random.Random(6)
    bad = ["ads-track", "casino-win", "cheap-pills", "spam-farm", "free-bets"]
    good = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    ending = {name: rng.choice(["com", "org", "net"]) for name in good} | dict.fromkeys(bad, "com")
    names = [rng.choice(bad) if rng.random() < .1 else rng.choice(good) for _ in range(1500)]
    hosts = [f"{rng.choice(['', 'www.', 'm.'])}{n}.example.{ending[n]}" for n in names]
    df = spark.createDataFrame([(i, f"https://{h}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 9999)}")
                                for i, h in enumerate(hosts)], "page_id bigint, url string")
    words = tuple(w for w in url_filter.BAD_WORDS if w not in left_out)
    got = [r for r in _rows(url_filter.judge(df, bad_words=words)) if r["rule"] is None]
    for name in bad:
        own = [r["verdict"] for r in got if name in r["host"]]
        assert own.count("block") >= 0.9 * len(own), (name, len(own))
    rest = [r["verdict"] for r in got if not any(b in r["host"] for b in bad)]
    assert rest.count("allow") >= 0.98 * len(rest)


# ---------------------------------------------------------------- 3 quality classifier

def test_cnn_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = quality_cnn.ByteCnn()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = rng.integers(0, 256, (5, quality_cnn.CHUNK))
    first, y = np.array([0, 2]), np.array([1.0, 0.0])

    def loss():
        p = net.combine(net.pooled(codes), first)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    grad = net.gradients(codes, first, y)
    for key, at in (("conv", (3, 2)), ("emb", (int(codes[0, 0]), 1)), ("bias", (4,)), ("mean", (4,)), ("max", (4,))):
        eps = 1e-5
        net.p[key][at] += eps
        up = loss()
        net.p[key][at] -= 2 * eps
        down = loss()
        net.p[key][at] += eps
        assert abs((up - down) / (2 * eps) - grad[key][at]) < 1e-4


def test_cnn_learns_and_covers_whole_texts(spark, docs):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(80))) for i in range(0, 400, 2)]
    bad = [(i, " ".join(rng.choice(["lorem***", "IPSUM!!", "dolor###"]) for _ in range(80))) for i in range(1, 400, 2)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string").withColumnRenamed("score", "score")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality_cnn.train(df, labels)
    got = _rows(quality_cnn.score(df, model))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 2 == 0) for r in held]) > 0.95
    # what stands at the very end of a long text counts
    text = good[0][1] * 60
    long = spark.createDataFrame([(1, text), (2, text + bad[0][1] * 40)], "doc_id bigint, text string")
    a, b = sorted(_rows(quality_cnn.score(long, model)), key=lambda r: r["doc_id"])
    assert b["score"] < a["score"]
    rows = _rows(quality_cnn.score(docs, model))
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_cnn.keep(docs, model).columns == docs.columns
    none = quality_cnn.train(df, labels.limit(0))
    assert none == 0.5 and _rows(quality_cnn.score(_empty(spark, docs), none)) == []


def test_cnn_trains_on_whole_texts(spark, monkeypatch):
    """What tells the labels apart stands where four spread chunks of 512 bytes do not reach."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["lorem ", "ipsum ", "dolor "]) for _ in range(500)) for _ in range(300)]
    texts = [t if i % 2 else t[:1380] + "###***!!" * 30 + t[1620:] for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    held = [r for r in _rows(quality_cnn.score(df, quality_cnn.train(df, labels))) if r["held_out"]]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    sample, y = quality_cnn.sample(df, labels, 3000)
    assert sorted(sample) == sorted(t.encode() for i, t in enumerate(texts) if zlib.crc32(b"%d" % i) % 3 != 1)
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 100_000)           # fewer documents, each of them whole
    fewer, y = quality_cnn.sample(df, labels, 3000)
    assert len(fewer) == len(y) and set(fewer) <= set(sample) and 95_000 < sum(map(len, fewer)) <= 100_000


def test_chunks_cover():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        k = int(quality_cnn.chunks_of(np.array([n]))[0])
        assert (k - 1) * quality_cnn.STEP + quality_cnn.CHUNK >= n
        assert k == 1 or (k - 2) * quality_cnn.STEP + quality_cnn.CHUNK < n


# ---------------------------------------------------------------- 4 sharding

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_hilbert_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.hilbert_index(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    walk = points[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, docs):
    for df in (docs, docs.filter("doc_id < 7"), _empty(spark, docs)):
        got = _rows(hilbert.hilbert_shards(df))
        texts = [r["text"] for r in _rows(df)]
        assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for t in texts)
        slots = {}
        for r in got:
            assert 0 <= r["shard"] < 24 and r["law"] == "rows" and r["grown_shard"] is None
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(slots.get(s, [])) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    by_id = {r["doc_id"]: r for r in _rows(hilbert.hilbert_shards(docs))}
    assert by_id[0]["text_crc32"] is None and by_id[4]["text_crc32"] == zlib.crc32(b"a")


def _codes(values, cuts=16):
    """Brute force: each value's code is the middle of the row quantiles it spans."""
    known = sorted(v for v in values if v is not None)
    if not known:
        return [0] * len(values)
    marks = [known[-(-k * len(known) // cuts) - 1] for k in range(1, cuts)]
    return [0 if v is None else (sum(v > m for m in marks) + sum(v >= m for m in marks)) // 2 for v in values]


def test_shards_equal_brute_force(spark):
    """Whole values are ranked, however long their common beginning; the order is the curve's."""
    rng = random.Random(8)
    rows = [(i, "y" * rng.randint(0, 40), rng.choice(["en", "en", "de", None]),
             rng.choice(["https://a.example/", "commoncrawl-"]) + rng.choice("aaabcdefgh")) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    got = {r["doc_id"]: r for r in _rows(hilbert.hilbert_shards(df))}
    axes = [_codes([r[2] for r in rows]), _codes([r[3] for r in rows]), _codes([len(r[1]) + 8 for r in rows])]
    curve = hilbert.hilbert_index(np.array(axes).T, hilbert.BITS)
    assert [got[r[0]]["curve"] for r in rows] == curve.tolist()
    order = sorted(range(700), key=lambda i: (curve[i], zlib.crc32(rows[i][1].encode()), i))
    flat = sorted(got, key=lambda i: (got[i]["shard"], got[i]["slot"]))
    assert flat == order
    assert len(set(axes[1])) >= 8 and max(axes[0]) - min(axes[0]) >= 8


@pytest.mark.parametrize("dim,value", [(0, "en"), (1, "source_of_pages_3"), (2, 30.0)])
def test_every_dimension_prunes(spark, dim, value):
    """Few and unequal languages, sources that share their first letters, sizes."""
    df = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('x', cast(pmod(xxhash64(id), 97) as int)) AS text",
        "array('en', 'en', 'en', 'de', 'fr')[pmod(xxhash64(id, 1), 5)] AS lang",
        "concat('source_of_pages_', pmod(xxhash64(id, 2), 9)) AS source")
    boxes = _rows(hilbert.pruning_boxes(hilbert.hilbert_shards(df)))
    assert sum(b[f"min_dim_{dim}"] <= value <= b[f"max_dim_{dim}"] for b in boxes) <= 20


def test_pruning_boxes(spark, tmp_path):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 as int)) AS text",
                                      "concat('s', id % 7) AS lang", "concat('t', id % 11) AS source")
    shards = hilbert.hilbert_shards(df).cache()
    boxes = _rows(hilbert.pruning_boxes(shards))
    assert len(boxes) == 24 and sum(b["rows"] for b in boxes) == 4000
    opened = [b for b in boxes if b["min_dim_0"] <= hilbert_value(spark, "s3") <= b["max_dim_0"]]
    assert len(opened) < 20
    hilbert.write_shards(shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000


def hilbert_value(spark, text):
    df = spark.createDataFrame([(text,)], "lang string")
    return df.select(hilbert.ordinal(df, "lang")).first()[0]


# ---------------------------------------------------------------- 5 page text

PAGES = [
    ("<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>The &amp; title</h1>"
     "<p>First  paragraph of\n the article, which is long enough to look like text.<p>Second &lt;one&gt; with &eacute; and <b>bold"
     "</b> words in it, also long enough.<br>Next line.</article><footer>&copy; 2020 Someone</footer></body></html>",
     "The & title\nFirst paragraph of the article, which is long enough to look like text.\nSecond <one> with é and "
     "bold words in it, also long enough. Next line."),
    (None, ""), ("", ""), ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""),
]


def test_html_text(spark):
    long = "A sentence with several ordinary words in it, and a comma. " * 4
    many = [(f"<html><head><title>t</title><script>x</script></head><body><nav><ul><li><a href=/1>one</a></li><li><a href=/2>two</a>"
             f"</li></ul></nav><div class='ad'>Buy {k} now</div><article><h1>Head {k}</h1><p>{long}{k}</p><p>{long}</p></article>"
             f"<div class='comments'><p>I liked it {k}</p></div><footer>&copy; {k}</footer></body></html>",
             f"Head {k}\n{(long + str(k)).strip()}\n{long.strip()}") for k in range(60)]
    every = PAGES + many
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(every)] + [(None, None, None, "x")] * 2,
                               "page_id bigint, url string, html string, text string")
    model = html_text.train(df)
    got = _rows(html_text.contract(html_text.extract(df, model)))
    assert len(got) == len(every) + 2
    wrong = [r for r in got if r["page_id"] is not None and r["text"] != every[r["page_id"]][1]]
    assert not wrong, wrong[:2]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    empty = _empty(spark, df)
    assert _rows(html_text.contract(html_text.extract(empty, html_text.train(empty)))) == []


def _plain_page(k, count=4):
    body = "".join(f"<p>{k} {j} A sentence with several ordinary words in it, and a comma. It goes on for a while.</p>"
                   for j in range(count))
    return f"<html><body><nav><ul><li><a href=/1>one</a></li></ul></nav><article>{body}</article></body></html>"


@pytest.mark.parametrize("copies,distinct,count", [(1000, 1, 4), (300, 8, 4), (1, 3, 3000)])
def test_html_text_of_copies_and_of_long_pages_only(spark, copies, distinct, count):
    sources = [_plain_page(k, count) for k in range(distinct)]
    assert count == 4 or min(map(len, sources)) > html_text.TRAIN_PAGE_CHARS
    df = spark.createDataFrame([(k, "u", sources[k]) for k in range(distinct)], "page_id bigint, url string, html string"
                               ).crossJoin(spark.range(copies).select()).repartition(4)
    got = _rows(html_text.contract(html_text.extract(df, html_text.train(df, 5))))
    assert len(got) == copies * distinct
    want = {k: "\n".join(re.findall(r"<p>(.*?)</p>", source)) for k, source in enumerate(sources)}
    assert all(r["text"] == want[r["page_id"]] for r in got)


def test_html_text_sample_is_of_distinct_pages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_text, "weak_labels", lambda page, f=html_text.weak_labels: seen.append(page) or f(page))
    for copies in (1, 700):
        df = spark.createDataFrame([(_plain_page(k),) for k in range(9) for _ in range(copies if k else 1)], "html string")
        seen.clear()
        html_text.train(df, 6)
        assert len(seen) == 6


HIDDEN_WORDS = ["overflow-hidden", "overflow-x-hidden", "hidden-print", "md:hidden", "lg:flex hidden xl:block"]


@pytest.mark.parametrize("attribute,text", [(f'class="{c}"', True) for c in HIDDEN_WORDS] + [
    ("id='x-hidden'", True), ('aria-hidden="false"', True), ('title="a hidden b"', True), ("data-x=hidden", True),
    ("hidden", False), ('class="a" HIDDEN', False), ("hidden=hidden", False), ('class="a"hidden id=b', False)])
def test_only_the_hidden_attribute_excludes(attribute, text):
    page = html_text.Page(f"<body><div {attribute}><p>shown</p></div></body>")
    assert page.never().tolist() == [False, False, not text, not text]


@pytest.mark.parametrize("where", ["body", "article"])
def test_html_text_with_hidden_in_class_names(spark, where):
    sources = [_plain_page(k).replace(f"<{where}>", f'<{where} class="{HIDDEN_WORDS[k % 5]}">') for k in range(20)]
    df = spark.createDataFrame([(k, "u", s) for k, s in enumerate(sources)], "page_id bigint, url string, html string")
    for r in _rows(html_text.extract(df, html_text.train(df))):
        assert r["text"] == "\n".join(re.findall(r"<p>(.*?)</p>", sources[r["page_id"]]))


def test_html_text_in_unseen_markup():
    """Pages in varied markup, made with another seed than those the trees learn from."""
    rng = random.Random(9)
    paragraphs = [" ".join(rng.choice(["river", "stone", "under,", "walked.", "evening", "of", "the", "quiet"])
                           for _ in range(rng.randint(6, 90))).capitalize() + "." for _ in range(80)]

    def rows(seed, count):
        for source in html_text.made_pages(paragraphs, count, seed):
            page = html_text.Page(source)
            marked, label = html_text._made_labels(source)
            keep = np.array(["zmain" not in w for w in marked.names])
            assert keep.sum() == len(page.tag)
            yield page, label[keep]

    train = list(rows(3, 300))
    model = html_text.Boosted().fit(np.concatenate([p.features() for p, _ in train]),
                                    np.concatenate([y for _, y in train]).astype(float))
    hit = found = true = 0
    for page, label in rows(77, 150):
        got = page.text(page.decode(model.probability(page.features()))).split("\n")
        want = page.text(label).split("\n")
        hit += sum(min(got.count(x), want.count(x)) for x in set(want))
        found, true = found + len(got), true + len(want)
    assert hit / found > 0.95 and hit / true > 0.95, (hit, found, true)


def test_html_parser_survives_broken_markup():
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<div class='a\"", "<a href=x>", "</a>", "<!-- ", "-->", "<script>", "</script>", "text ", "<", ">", "&amp",
            "<li>", "</ul>", "<td>", "<table>", "<br/>", "<b", "é"]
    for _ in range(300):
        page = html_text.Page("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
        x = page.features()
        assert len(x) == len(page.tag) and np.isfinite(x).all()
        kept = page.decode(rng_probability(len(x)))
        assert all(not kept[e] or kept[page.parent[e]] for e in range(1, len(kept)))
        page.text(kept)


def rng_probability(n):
    return np.random.default_rng(n).random(n)


# ---------------------------------------------------------------- 6 near duplicates

def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(
        tuple(words[i:i + 5]) for i in range(len(words) - 4))


def _brute_components(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def test_block_overlaps(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 37)
    rng = np.random.default_rng(0)
    left, right = ([np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(n)]
                   for n in (20, 30))
    got = ngram_join._overlaps(left, right)
    assert all(got[i, j] == len(np.intersect1d(left[i], right[j])) for i in range(20) for j in range(30))


def _near_copies(seed, families=25, size=14):
    rng = random.Random(seed)
    passage = [f"p{rng.randint(0, 9999)}" for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 99999)}" for _ in range(rng.choice([6, 9, 40, 120]))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99999)}"
            if rng.random() < 0.2:
                own += passage
            rows.append(" ".join(own))
    rows += [None, "", " \n", "one two", "ONE\ttwo", "one two three", "a b c d e", "a b c d e"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,limit,rounds,block", [(1, ngram_join.LIST_LIMIT, 1, 1024), (2, 1, 0, 3), (3, 8, 2, 4)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, seed, limit, rounds, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rows = _near_copies(seed)
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id bigint, text string, x int, comp int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in _rows(ngram_join.near_duplicates(df, list_limit=limit, rounds=rounds))}
    assert got == _brute_components(rows)


def test_near_duplicates_awkward_rows(spark, docs):
    got = _rows(ngram_join.near_duplicates(docs))
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[12]["component_id"] == 11 and by_id[0]["n_shingles"] == 0 and by_id[None]["component_id"] is None
    assert _rows(ngram_join.near_duplicates(_empty(spark, docs))) == []


# ---------------------------------------------------------------- 7 byte-level BPE

def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    import tiktoken
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {(r["doc_id"], r["text"]) for r in _rows(docs)}
    want = sorted((-1 if d is None else d, hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts)
    for block in (bpe_words.BLOCK_BYTES, 700):
        got = _rows(bpe_words.digests(bpe_words.encode_decode(docs, path, block_bytes=block)))
        assert len(got) == docs.count()
        assert sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got}) == want
    assert _rows(bpe_words.digests(bpe_words.encode_decode(_empty(spark, docs), path))) == []


# ---------------------------------------------------------------- 8 packing

def test_packing(spark, docs):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in _rows(docs)}
    got = _rows(packing.digests(packing.pack(docs, path, block_bytes=20000)))
    pieces, sequences = {}, {}
    for r in got:
        ids = want[r["doc_id"]]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(len(want[r["doc_id"]]) for r in _rows(docs))
    assert sum(r["length"] for r in got) == total
    for doc, own in pieces.items():
        if doc != 20:                                  # repeated rows are documents of their own
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n
            assert at == len(want[doc])
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert _rows(packing.pack(_empty(spark, docs), path)) == []


def test_packing_balances_costs():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1500, 4000)
    pieces, costs = packing.pack_lengths(lengths, 2048)
    full = np.zeros(len(costs))
    for _, _, n, seq, _ in pieces:
        full[seq] += n
    whole = np.array(costs)[full == 2048]
    one = np.zeros(1 + int(lengths.sum()) // 2048)      # first fit in input order, cut at the edges
    at = 0
    for n in lengths.tolist():
        while n:
            step = min(n, 2048 - at % 2048)
            one[at // 2048] += packing.LINEAR * step + packing.QUADRATIC * step * step
            at, n = at + step, n - step
    assert whole.std() < one[:-1].std()


# ---------------------------------------------------------------- 9 quality rules

def _measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_rule_ledger(spark, docs):
    got = _rows(quality_rules.contract(quality_rules.apply_policy(quality_rules.ledger(docs))))
    texts = {r["doc_id"]: r["text"] for r in _rows(docs)}
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, repeat = _measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, chars, symbols, dup, repeat), r
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert _rows(quality_rules.ledger(_empty(spark, docs))) == []


def test_ablation(spark, docs):
    rows = quality_rules.ledger(docs).cache()
    mask = quality_rules.mask_of(quality_rules.POLICIES["full"])
    failed = [r["failed"] & mask for r in _rows(rows)]
    for r in _rows(quality_rules.ablation(rows)):
        bit = quality_rules.mask_of((r["rule"],))
        assert r["failed_docs"] == sum(bool(f & bit) for f in failed)
        assert r["only_this_rule"] == sum(f == bit for f in failed)


# ---------------------------------------------------------------- 10 nearest neighbours

def _brute(ids, x, q, k=10):
    own = ids == q
    d = np.sqrt(((x - x[own][0]) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))
    return [(int(ids[i]), d[i]) for i in order if not own[i]][:k]


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5100, [0.0] * 24, 1), (5200, [None] + [1.0] * 23, 1), (5300, [float("nan")] * 24, 1),
           (5400, [float("inf")] * 24, 1), (5500, [1.0] * 3, 1), (None, [1.0] * 24, 1), (5600, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in _rows(hash_forest.nearest(df, df.filter("vec_id % 100 = 0"), shard_rows=1000)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    ids, hit = np.arange(3000), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        best = _brute(ids, x.astype(np.float64), q)
        if 100 <= q < 400:
            assert [f[1] for f in found] == [b[0] for b in best]
        hit += len({f[1] for f in found} & {b[0] for b in best})
    assert hit >= 0.9 * 10 * len(got)
    few = df.filter("vec_id < 4")
    assert len(_rows(hash_forest.nearest(few, few))) == 12
    assert _rows(hash_forest.nearest(_empty(spark, df), df)) == []


def test_policy_does_not_reach_the_scan(spark, docs):
    """The policy stands above the ledger: below its projections no filter splits a text again."""
    kept = quality_rules.keep(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("split(")
    assert not any("split(" in line or "transform(" in line for line in plan.splitlines() if "Filter " in line)
    verdict = quality_rules.apply_policy(quality_rules.ledger(docs, carry=True))
    want = [r["row"]["text"] for r in verdict.collect() if r["kept"]]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(t or "" for t in want) and kept.schema == docs.schema


def test_words_encoded_in_lines_equal_single_words(monkeypatch):
    """Also when the memory of words overflows between blocks."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rng = random.Random(3)
    alpha = [*"ab'  \n\t.!19éß中𝒳 \xa0\r\x1c\x85\x0b", "'s", "'re", " '", "<|endoftext|>", "\n\n"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for size in (10, packing.REMEMBERED):
        monkeypatch.setattr(packing, "REMEMBERED", size)
        for lo in (0, 1000, 2000):
            data, off = arrays.text_bytes(pa.array(texts[lo:lo + 1000]))
            ids, at = packing.encode_block(path, data, off, None)
            want = tok.encode_batch(texts[lo:lo + 1000], add_special_tokens=False)
            assert all(ids[at[k]:at[k + 1]].tolist() == w.ids for k, w in enumerate(want))


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 55, 56, 57, 300, 5000])
def test_packed_sets_are_whole_and_short(n):
    tokens = np.unique(np.random.default_rng(n).integers(0, 2 ** 64, n, dtype=np.uint64))
    for own in (tokens, np.arange(n, dtype=np.uint64) << np.uint64(16), ~(np.arange(n, dtype=np.uint64) << np.uint64(16))):
        packed = ngram_join._pack48(own)
        assert (ngram_join._unpack48(packed) == np.sort(own >> np.uint64(16))).all()
        assert n < 300 or len(packed) < 5.3 * n


def test_counts_travel_in_the_fewest_bytes():
    for most, width in ((0, 1), (255, 1), (256, 2), (65535, 2), (65536, 4)):
        raw = ngram_join._narrow(np.array([0, most])).tobytes()
        assert len(raw) == 2 * width and ngram_join._widened(raw, 2).tolist() == [0, most]


def _long_texts(n_bytes):
    """Texts of some 2,000 bytes, many of their words rare."""
    import pyarrow as pa
    rng = np.random.default_rng(8)
    words = np.array([f"w{k:x}" for k in range(200_000)])
    made, size = [], 0
    while size < n_bytes:
        made.append(" ".join(words[(len(words) * rng.random(350) ** 3).astype(int)]))
        size += len(made[-1])
    return pa.array(made)


def _peak(run):
    import tracemalloc
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_packing_holds_a_stretch_not_a_block(monkeypatch):
    """The arrays of words and ids are many times the text; only a stretch's are held, with the same ids."""
    path = tokenizer_path("byte_bpe_50k.json")
    data, off = arrays.text_bytes(_long_texts(8 << 20))
    packing._tokenizer.cache_clear()
    packing._tokenizer(path)
    (ids, at), peak = _peak(lambda: packing.encode_block(path, data, off, 1))
    assert peak < 8 * len(data)
    for name, value in (("STRETCH_BYTES", len(data)), ("STRETCH_BYTES", 5000), ("REMEMBERED_IDS", 3000)):
        monkeypatch.setattr(packing, name, value)
        packing._tokenizer.cache_clear()
        same, same_at = packing.encode_block(path, data, off, 1)
        assert (same == ids).all() and (same_at == at).all()


def test_words_forgotten_are_the_unused(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    known = packing.Words(1 << 17)
    known.add(np.arange(8, dtype=np.uint64), np.arange(8, dtype=np.uint32) + 70_000, np.ones(8, np.int64))
    known.used[[2, 5]] = True
    known.forget(np.array([7]))
    assert known.hashes.tolist() == [2, 5, 7] and not known.used.any()
    assert known.flat[known.starts].tolist() == [70_002, 70_005, 70_007] and known.size == 3
    known.used[:] = True
    known.add(np.array([1, 9], np.uint64), np.array([3, 4, 6], np.uint32), np.array([2, 1]))
    known.used[:] = True
    known.forget(np.array([0, 4]))                           # five used are more than half
    assert known.hashes.tolist() == [1, 9] and known.flat.tolist() == [3, 4, 6]


def test_ngram_sets_hold_a_stretch_not_a_block(monkeypatch):
    data, off = arrays.text_bytes(_long_texts(ngram_join.BLOCK_BYTES))
    own, peak = _peak(lambda: sum(len(x) for x in ngram_join.sets_of(data, off)))
    assert peak < 4 * len(data)
    monkeypatch.setattr(ngram_join, "STRETCH_BYTES", len(data))
    assert own == sum(len(x) for x in ngram_join.sets_of(data, off))
