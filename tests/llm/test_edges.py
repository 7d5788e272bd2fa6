"""Hard edges of the operators: derived queries, long runs, moved passages, repeated ids, odd tables through the pipeline."""

import collections
import itertools
import math
import random
import re
import time

import pytest

import corpus_pipeline
from panelflow.llm import decontaminate, labelled, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"


# ---- secrets


PARTS = ["password", "Secret", "api_key", "APIKEY", "tok", "en", "=", ":", '"', "'", " ", "\n", "AKIA", "ABCDEF1234567890", "deadbeef" * 4, "-----BEGIN ",
         "RSA ", "PRIVATE KEY-----", "ghp_", "a1B2" * 9, "xoxb-", "123456-abcdef", "eyJ", "abcdefgh9", ".", ".eyJ", "_-", "http", "9z+", "://", "user", ":", "pa/ss", "@", "/", "é", "ſecret="]


def soup(rng, n):
    return "".join(rng.choices(PARTS, k=n))


def test_rules_find_what_a_full_scan_finds():
    rng = random.Random(1)
    texts = ["", *(soup(rng, rng.randint(1, 60)) for _ in range(3000))]
    got = secrets.scan_block(texts)
    hits = collections.Counter()
    for text, spans in zip(texts, got):
        want = sorted((m.start(), rank, m.end(), r.kind) for rank, r in enumerate(secrets.RULES) for m in re.compile(r.pattern, re.ASCII).finditer(text) if r.keep(m))
        assert spans == want, text
        hits.update(k for *_, k in want)
    assert set(hits) == {r.kind for r in secrets.RULES}


def test_queries_are_derived_from_the_regexes():
    given = {
        "assign": {"password", "passwd", "secret", "token", "api_key", "apikey"}, "access": {"akia"}, "url_login": {"://"},
        "hub_token": {f"gh{c}_" for c in "pousr"}, "chat_token": {f"xox{c}-" for c in "abprs"},
    }
    for rule in secrets.RULES:
        query = secrets.mandatory(rule.pattern)
        if rule.kind in given:
            assert {w for alt in query for w in alt} == given[rule.kind] and all(len(alt) == 1 for alt in query)
    of = secrets.mandatory
    assert of("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----") == [["-----begin ", "private key-----"]]
    assert of("[0-9a-f]+") == [] and of("ab|abcd") == [] and of("abc?d") == [["abcd"], ["abd"]] and of("a.bcd.e") == [["bcd"]]
    assert of("(?:abc|xyz)+q") == [["abc"], ["xyz"]] and of("(?:one|two)(?:red|sky)") == [[w] for w in ("onered", "onesky", "twored", "twosky")]
    assert of("abc(?:def.*|ghi)") == [["abc", "def"], ["abc", "ghi"]] and of("[a-z]{3}") == [] and of("fo{1,1}o") == [["foo"]]


@pytest.mark.parametrize("run", ["abcdefghij", "eyJ", "a.b-c+", "://", "xox", "0f", "AKIA", "token=", "://a:", "-----BEGIN A "])
def test_long_runs_are_read_in_linear_time(run):
    start = time.time()
    secrets.scan_block([(run * 200_000)[:1_000_000] + "://"])
    assert time.time() - start < 5


# ---- toxicity


def test_the_composed_table_is_the_product_of_its_parts():
    parts = (toxicity.INSULTS, toxicity.THREATENING, toxicity.AIMED, toxicity.NEGATED, toxicity.REPORTED)
    for classes in itertools.product(range(6), repeat=5):
        states, total = [0] * len(parts), 0.0
        for c in classes:
            moved = [p.step(s, c) for p, s in zip(parts, states)]
            if c in (toxicity.INSULT, toxicity.THREAT):
                total += math.prod(f for _, f in moved)
            states = [s for s, _ in moved]
        assert abs(total - toxicity.clause_score(list(classes), [1.0] * 5)) < 1e-12


def test_a_clause_is_one_however_long(spark):
    grammar = toxicity.Grammar({"vile": 3.0})
    import pyarrow as pa

    for n in (5, 38, 39, 500):
        f = grammar.texts(pa.array([f"he is not {'so ' * n}vile", f"he is {'so ' * n}vile", f"he is {'so ' * n}fine"]))
        assert f[0, 0] == pytest.approx(3.0 * 1.5 * 0.4) and f[1, 0] == pytest.approx(4.5) and f[2, 0] == 0


# ---- labelled samples


def test_the_bound_holds_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 3, 1, 2).collect()
    assert len(got) <= 2 and all(r.text in ("text 0", "text 1", "text 10", "text 11") for r in got if r.id < 2)


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_quality_takes_ids_of_any_type(spark, kind):
    rows = [(i, ("good words here. " if i % 2 else "!!! BUY $$$ ") * 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "quality")
    assert quality.classify(docs, labels).count() == 40


# ---- decontamination


def leaks_of(items, texts):
    count = lambda w: collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    out = {}
    for item, wanted in items:
        a = count(wanted.split())
        for doc, text in texts:
            w, best = text.split(), 0.0
            if not set(w) & set(wanted.split()):
                continue
            for s in range(max(1, len(w) - len(wanted.split()) + 1)):
                b = count(w[s:s + len(wanted.split())])
                both = (a & b).total()
                best = max(best, both / (a.total() + b.total() - both))
            if best >= 0.8:
                out[doc, item] = best
    return out


def test_moved_and_inserted_passages_are_found(spark):
    """Halves swapped, words inserted at the front, in the middle and at the end, words left out, short documents: by brute force."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    items, texts, no = [], [], 0
    for i in range(40):
        item = say(rng.choice([5, 12, 60, 120]))
        items.append((i, " ".join(item)))
        n, k = len(item), rng.randint(1, 8)
        half = n // 2
        for body in (
            item[half:] + item[:half], say(k) + item[:n - k], item[:half] + say(k) + item[half:], item[k:] + say(k), item[:half] + item[half + k:],
            item[: max(1, n - k)], item * 2, item[half:] + item, [w for w in item for _ in range(1 + (rng.random() < 0.03))],
        ):
            for around in (0, rng.randint(1, 9)):
                texts.append((no, " ".join(say(around) + body + say(around))))
                no += 1
    want = leaks_of(items, texts)
    found = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(want) and len(want) > 150
    assert all(abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-12 for r in found)


def test_items_of_very_many_shingles_and_repeated_ids(spark):
    long = " ".join(f"v{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, "front " + long), (1, "nothing"), (2, None), (2, "again a b c d e f"), (None, "again a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "again a b c d e f"), (2, "other words in this one here")], "item_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in found} == {(1, 1, 1.0), (2, 2, 1.0), (None, 2, 1.0)}


# ---- the pipeline on odd tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


WIDE = "doc_id long, text string, lang string, _row_number long, key string, component_id int, kept boolean"


@pytest.mark.parametrize("ids", ["plain", "odd"])
def test_stages_keep_all_columns_and_null_and_repeated_rows(spark, folder, ids):
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    base = [(1, "one two three four five six", "en", 7, "k", 3, True), (2, "one  two three four five six", None, 8, "k", 3, True), (3, None, "en", 9, None, None, None),
            (4, "", "en", 1, "k", 1, False), (5, "x" * 1_000_000, "en", 2, "k", 1, False), (6, f"see {leak} end", "en", 3, "k", 1, False)]
    if ids == "odd":
        base += [(None, "no id at all in this row", "en", 4, "k", 1, False), (6, "same id other text here", "en", 5, "k", 1, False), (6, "same id other text here", "en", 5, "k", 1, False)]
    at = spark.createDataFrame(base, WIDE)
    left = []
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, at, folder)
        assert out.columns == at.columns
        at = spark.createDataFrame(out.collect(), WIDE)
        left.append(sorted((str(r.doc_id), (r.text or "")[:8], r._row_number) for r in at.collect()))
    assert ("2", "one  two", 8) in left[0] and not any(r[0] == "1" for r in left[0])
    assert not any(r[1].startswith("see") for r in left[-1]) and ("5", "x" * 8, 2) in left[-1]
    if ids == "odd":
        assert [r[1] for r in left[-1]].count("same id ") == 1 and ("None", "no id at", 4) in left[-1]
    assert corpus_pipeline.STAGES[-1][1](spark, at, folder).count() >= len(left[-1])


def test_stages_take_empty_tables(spark, folder):
    none = spark.createDataFrame([], WIDE)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
