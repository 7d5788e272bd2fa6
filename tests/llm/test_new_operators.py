"""Phrase mining, URL filter and fill-in-middle against brute force, with nulls, empty, long and repeated rows."""

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
import zstandard

from panelflow.llm import middle, phrases, url_filter

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
LONG = "".join(random.Random(3).choices(["word", "é", " ", "\n", "x" * 400, "文", "."], k=6000))


# ---- fill-in-middle


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    held = [None, "", "a", "<P> inside", "tail <", "<S", LONG, "x" * 300_000, *("".join(rng.choices("ab é文.\n<SPM>", k=rng.randint(1, 400))) for _ in range(120))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(held)] + [(5, "<S", "clash", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, frames string, n int")


def plain_form(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [7, 1000, middle.FRAME_BYTES])
def test_fill_in_middle_equals_brute_force_at_any_frame_size(texts, size):
    want = sorted((str(r.doc_id), *plain_form(r.doc_id, r.text)) for r in texts.collect() if size > 100 or len(r.text or "") < 5000)
    kept = texts if size > 100 else texts.filter("text IS NULL OR length(text) < 5000")
    spans = middle.transform(middle.to_frames(kept, frame_bytes=size), frame_bytes=size)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, middle.output_text(r.output)) for r in spans.collect())
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = {(str(r.doc_id), r.restored_sha256) for r in middle.digests(spans).collect()}
    assert back == {(str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()}


def test_frames_are_independent_and_count_what_is_before_them():
    n, frames = middle.frames_of(LONG.encode(), zstandard.ZstdCompressor(), 500)
    units, unpack = UNIT.findall(LONG), zstandard.ZstdDecompressor()
    assert n == len(units) and len(frames) > 100
    starts = [0]
    for u in units:
        starts.append(starts[-1] + len(u))
    for f in random.Random(2).sample(frames, 40):
        assert LONG[f["first_char"]:f["first_char"] + f["chars"]] == unpack.decompress(f["data"]).decode()
        assert f["first"] == sum(s < f["first_char"] for s in starts[:-1])
        assert f["units"] == sum(f["first_char"] <= s < f["first_char"] + f["chars"] for s in starts[:-1])


def test_only_cut_frames_are_read_and_others_are_taken_over():
    class Counting:
        def __init__(self):
            self.inner, self.calls = zstandard.ZstdDecompressor(), 0

        def decompress(self, data):
            self.calls += 1
            return self.inner.decompress(data)

    text = " ".join(f"word{i}" for i in range(40_000)).encode()
    n, frames = middle.frames_of(text, zstandard.ZstdCompressor(), 4096)
    unpack = Counting()
    seek, out = middle.Seek(frames, n, unpack), middle.Splice(zstandard.ZstdCompressor(), 4096)
    a, b = seek.place(n // 3), seek.place(n // 2)
    for span in (((0, 0, 0), a), (b, seek.place(n)), (a, b)):
        seek.copy(*span, out)
    out.close()
    assert unpack.calls <= 6 and len(set(out.frames) & {f["data"] for f in frames}) > 60


def test_fill_in_middle_of_an_empty_table(spark):
    frames = middle.to_frames(spark.createDataFrame([], "doc_id string, text string"))
    assert middle.digests(middle.transform(frames)).count() == 0


# ---- phrases


def brute_phrases(rows, least):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if any(len(v) > len(w) and c >= a and any(v[i:i + len(w)] == w for i in range(len(v))) for (o, v), c in cand.items() if o == lang):
            continue
        score, k, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, got in out.items() for i, (s, a, p, left, right) in enumerate(sorted(got)))


def corpus(seed, size=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Über", "New", "York", "don't"]
    def text():
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(["new york city hall", "New\tYork", " ".join(rng.choices(vocab, k=rng.randint(1, 6)))]))
            parts.append(rng.choice([" ", ". ", ",", "\n", "\x0b", "  "]))
        return "".join(parts)
    rows = [(i, text(), rng.choice(["en", "de", None]), "x", i) for i in range(size)]
    return rows + [(None, None, "en", "x", 1), (3, "", "en", "x", 1)] + [rows[0]] * 30


@pytest.mark.parametrize("seed, share", [(1, 8), (2, 1), (3, 500)])
def test_phrases_equal_brute_force_whatever_the_sample(spark, seed, share):
    """Of one row in 500 next to nothing is proposed, so that the expansion counts nearly all."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, size long")
    got = sorted(tuple(r) for r in phrases.mine(docs, least=20, share=share).collect())
    want = brute_phrases([(r[2], r[1]) for r in rows], 20)
    assert got == want and len(got) > 20


def test_sample_that_proposes_nothing_still_ends_closed(spark):
    docs = spark.createDataFrame([(i, "a b c d e f. a b c d e", "en") for i in range(50)], "doc_id long, text string, lang string")
    got = {(r.size, r.phrase): r.f for r in phrases.frequent_phrases(docs, least=50, share=1_000_000).collect()}
    assert got[5, "a b c d e"] == 100 and got[5, "b c d e f"] == 50 and got[0, ""] == 550


def test_long_texts_are_cut_where_phrases_end(monkeypatch):
    text = "alpha beta gamma. " * 500
    whole = {(p, s): c for names, ps, s, cs in phrases.count_piece(pa.array([text]), pa.array(["en"]), None, None) for p, c in zip(ps.cast(pa.string()).to_pylist(), cs)}
    monkeypatch.setattr(phrases, "PIECE_BYTES", 100)
    parts = collections.Counter()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    for langs, texts_of in phrases.bounded(batch):
        for _, ps, s, cs in phrases.count_piece(texts_of, langs, None, None):
            for p, c in zip(ps.cast(pa.string()).to_pylist(), cs):
                parts[p, s] += c
    assert parts == whole


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right, n = 10 ** 13 + 7, 3 * 10 ** 13 + 1, 2 * 10 ** 13 + 3, 9 * 10 ** 15 + 11
    freq = spark.createDataFrame([("en", 0, "", n), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, size int, phrase string, f long")
    assert phrases.collocations(freq).collect()[0].score == 1000 * a * n // (left * right)


def test_phrases_of_an_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


# ---- URL filter


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def brute_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def brute_judge(rows):
    rated = []
    for key, url in rows:
        host, path = brute_parts(url)
        fold = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:8], 16) % 5
        rated.append((key, host, path, *brute_rule(host, path), host + path, fold))
    seen = {"allow": collections.Counter(), "block": collections.Counter()}
    grams = lambda t: [(" " * 5 + t + " ")[i:i + 6] for i in range(len(t) + 1)]
    for _, _, _, _, ruled, text, fold in rated:
        if ruled and fold:
            for g in grams(text):
                seen[ruled].update((g[5 - k:] for k in range(6)))
    after = {c: collections.defaultdict(list) for c in seen}
    for c, got in seen.items():
        for e, x in got.items():
            after[c][len(e), e[:-1]].append(x)

    def p(c, e):
        below = p(c, e[1:]) if len(e) > 1 else 1 / 256
        held = after[c].get((len(e), e[:-1]))
        return (seen[c][e] + len(held) * below) / (sum(held) + len(held)) if held else below

    memo = {}
    def score(text):
        if text not in memo:
            micro = [int(math.copysign(math.floor(abs(x) + 0.5), x)) for g in grams(text) for x in [(math.log(p("allow", g)) - math.log(p("block", g))) * 1e6]]
            memo[text] = sum(micro) / len(micro)
        return memo[text]

    bins = [(math.floor(score(r[5]) / 15625), r[4]) for r in rated if r[4] and not r[6]]
    good, bad = sum(v == "allow" for _, v in bins), sum(v == "block" for _, v in bins)
    cut = 0
    if good and bad:
        cuts = {b for b, _ in bins} | {max(b for b, _ in bins) + 1}
        cut = min(cuts, key=lambda t: (-(sum(v == "allow" and b >= t for b, v in bins) * bad + sum(v == "block" and b < t for b, v in bins) * good), abs(t), t))
    return [(k, h, q, rule, ruled or ("allow" if math.floor(score(t) / 15625) >= cut else "block"), math.floor(score(t))) for k, h, q, rule, ruled, t, _ in rated]


URLS = [
    None, "", "no scheme", "://", "http://ORG/x", "http://a.org", "http://example.org/es/1", "http://sub.EXAMPLE.org/en/12?x=/es/#y", "http://notexample.org/en/1",
    "https://x.com/fr/", "https://x.com/de/", "https://x.com/DE/", "https://xcom/fr/", "ftp://a.org:80/", "http://é文.net/ü?", "x://y://org/z", "http://a.com/fr", "http://com/fr/1",
    "http://long.net/" + "p" * 20_000,
]


def url_rows(seed=5, n=400):
    rng = random.Random(seed)
    made = [f"http://{rng.choice(['spam', 'good', 'x'])}{rng.randint(0, 9)}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['fr', 'de', 'en', 'es'])}/{rng.randint(0, 999)}" for _ in range(n)]
    return [*enumerate(URLS + made), (None, "http://z.net/fr/1"), (7, "http://z.net/de/1"), (7, "http://z.net/de/1")]


def test_urls_equal_brute_force(spark):
    rows = url_rows()
    pages = spark.createDataFrame([(k, u, "t", "g") for k, u in rows], "page_id long, url string, text string, gram string")
    got = [tuple(r) for r in url_filter.judge(pages).collect()]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(brute_judge(rows), key=order)


def test_a_hot_gram_and_a_cold_one_give_the_same_scores(spark, monkeypatch):
    rows = url_rows(6, 100)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(str(tuple(r)) for r in url_filter.judge(pages).collect())
    monkeypatch.setattr(url_filter, "HOT", 50)
    assert sorted(str(tuple(r)) for r in url_filter.judge(pages).collect()) == want


def test_the_models_tell_held_out_rule_urls_apart(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    judged = url_filter.judge(pages).withColumn("bin", url_filter.bin_of(url_filter.F.col("score_micronats"), url_filter.F.lit(1)))
    held = [(r.verdict, r.bin) for r in judged.filter("rule IS NOT NULL").filter(url_filter.fold(url_filter.F.col("page_id")) == 0).collect()]
    cut = min({b for _, b in held}, key=lambda t: sum((b >= t) != (v == "allow") for v, b in held))
    assert sum((b >= cut) == (v == "allow") for v, b in held) > 0.9 * len(held)


def test_urls_without_labels_and_no_urls(spark):
    none = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id int, url string")
    assert {r.verdict for r in url_filter.judge(none).collect()} == {"allow"}
    assert url_filter.judge(none.limit(0)).count() == 0
