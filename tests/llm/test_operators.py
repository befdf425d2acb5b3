"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on the odd corpus and an empty one."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_corpus import prose
from pyspark.sql import functions as F

from tidebook.llm import _store, _text, components, decontamination, embedding_dedup, language_id, minhash_dedup, packing, pii, quality, sharding, toxicity, warc
from tidebook.llm.queries import ORACLES, QUERIES


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def held_out(doc_id, folds=5, fold=0) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


# Text helpers


def test_words_and_shingle_sets_equal_python(rows):
    texts = [r[1] for r in rows]
    for table, pattern in ((_text.space_words(), r"[^\x20\x09-\x0D]+"), (_text.alnum_words(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        buf, at = _text.text_bytes(pa.array(texts, pa.string()))
        starts, ends, hashes, words = _text.words(buf, at, table)
        seen: dict[str, int] = {}
        for i, t in enumerate(texts):
            want = re.findall(pattern, lower(t or ""))
            got = [_text.LOWER[buf[s:e]].tobytes().decode() for s, e in zip(starts[words[i] : words[i + 1]], ends[words[i] : words[i + 1]])]
            assert got == want
            for w, h in zip(want, hashes[words[i] : words[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_slices_bound_bytes_and_keep_all_rows():
    batch = pa.RecordBatch.from_pylist([{"text": "x" * n} for n in (5, 0, 5000, 3, 3, 3)])
    parts = list(_text.slices(batch, most=8))
    assert sum(p.num_rows for p in parts) == 6 and max(p.num_rows for p in parts) <= 3
    assert list(_text.slices(batch.slice(0, 0))) == []


# Components


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)] + [(None, 3), (7, 7)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("most", [200_000, 100, 0])
def test_hubs_do_not_meet_in_one_task(spark, most):
    """A hub that is the least of its neighbours, one that is the greatest, and one amid them, whether minima are broadcast, heavy ones are, or edges are salted."""
    n = 5_000
    rows = spark.range(1, n).select((F.col("id") + 10 * n).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(10 * n)).otherwise(F.col("id") + 10 * n + 1).alias("b"))
    rows = rows.unionByName(spark.range(n).select(F.lit(40 * n).alias("a"), (F.col("id") + 30 * n).alias("b")))
    rows = rows.unionByName(spark.range(2 * n).select((F.col("id") + 50 * n).alias("a"), F.lit(51 * n).alias("b")))
    found = components.connected_components(rows, most=most).groupBy("component").count().collect()
    assert {tuple(r) for r in found} == {(10 * n, n - 1), (11 * n - 1, 2), (30 * n, n + 1), (50 * n, 2 * n)}


def test_a_hub_of_100_000(spark):
    rows = spark.range(100_000).select(F.lit(7_000_000).alias("a"), "id").toDF("a", "b")
    found = components.connected_components(rows.unionByName(rows.select("b", F.lit(3_000_000).alias("a")).toDF("a", "b")), most=1000).groupBy("component").count().collect()
    assert [tuple(r) for r in found] == [(0, 100_002)]


# 1 Packing


def _tokens(text):
    tokenizer = packing._tokenizer("word_bpe_49k.json")
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


@pytest.mark.parametrize("p", [packing.Params(keep_ids=True), packing.Params(size=64, block=40, nearly_full=0.9, fan_in=2)])
def test_packing_round_trip(spark, corpus, rows, p):
    got = packing.pack(corpus, p).collect()
    want = Counter()
    for r in rows:
        ids = _tokens(r[1])
        for k, s in enumerate(range(0, len(ids), p.size)):
            part = ids[s : s + p.size]
            want[r[0], k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    if p.keep_ids:
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= p.size
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.1 * total / p.size + 2


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


def test_encoder_equals_the_tokenizer_on_odd_texts():
    tokenizer = packing._tokenizer("word_bpe_49k.json")
    texts = ["", "  ", "It's don't THEY'LL", "<|startoftext|> x<|ENDOFTEXT|>", "a" * 200 + " b", "İstanbul ΣΑΣ ß ẞ", "12345 3.14 1,000", "é café café x\x1cz", "!!! ... ,,, |", "日本語 テスト", "ÀÉ×÷ a×, b÷",
             "a.b.c, 'tis 's", "&amp; #tag $5 100%", "é!!!!!!!!!!!!!!!!!!!!!!!!!!", "\x00 a\x7fb\x85c", "word Word WORD, word. word"]
    encoder = packing.WordEncoder("word_bpe_49k.json", 20)  # so few that it forgets all the time
    for group in ([t] for t in texts), (texts, texts[::-1]):
        for some in group:
            ids, at = encoder.encode(*_text.text_bytes(pa.array(some, pa.string())))
            for k, t in enumerate(some):
                assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_tokenizer_that_does_not_go_by_words_gets_whole_texts(spark, corpus, rows):
    tokenizer = packing._tokenizer("byte_bpe_50k.json")
    assert packing.goes_by_words(packing._tokenizer("word_bpe_49k.json")) and not packing.goes_by_words(tokenizer)
    texts = ["", "Two  spaces\nand CASE", " leading", "é ünï 日本"]
    ids, at = packing.WordEncoder("byte_bpe_50k.json", 20).encode(*_text.text_bytes(pa.array(texts, pa.string())))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 3, 2]), 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit(np.zeros(0, np.int64), 10) == []


# 2 PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(text: str) -> list[tuple[int, int, str, int]]:
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


PRIVATE = [
    "write to a.b@mail.example.com, or x@y.z@q.r_s@t.uu now", "a@b a@b. @c.d ..@-.-", "at 1.2.3.4 and 1.2.3.4.5.6.7.8 or 256.1.1.1 and 0001.002.03.255 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 12 3",
    "call +33 (0)1 23-45.67 89 or +1 2 or +123456789012345678", "é😀 ünï 4111111111111111 😀x@y.zz +49 30 1234567", "x" * 3000 + "@", "1" * 4000, "1 " * 3000, "+1" + " " * 2000, "a@" + "b." * 500 + "c", None, "", "no data here",
]


def test_base_spans_equal_the_contract(spark, rows):
    texts = [*PRIVATE, *(r[1] for r in rows)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pii_digest(df).collect()}
    for k, t in enumerate(texts):
        base = _base(t or "")
        joined = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in base)
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(x[2] == kind for x in base) for kind in PATTERNS]
        assert set(joined.split(",")) <= set(got[k]["spans"].split(",")) | {""}


def test_disclosing_words_go_where_the_entity_is_named(spark):
    texts = [f"filler{k % 5} number {k} zanzibar met bob@x.org in common room {k}" for k in range(4)] + [f"common room number {k} filler{k % 5} was empty in march" for k in range(20)] + ["zanzibarette common"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("terms", F.lit("kept"))
    got = {r["doc_id"]: r for r in pii.sanitise(df, pii.Params(support=3)).collect()}
    assert got[0]["terms"] == "kept"
    assert got[0]["clean"] == "filler0 number 0   [email] in common room 0"
    assert [s["kind"] for s in got[0]["spans"]] == ["removed", "removed", "email"]
    assert got[10]["clean"] == texts[10] and not got[24]["spans"]
    # n(term) > n(term, entity) makes a word less telling: 4 of 5 texts with it hold the entity.
    more = spark.createDataFrame([*enumerate(texts), (99, "zanzibar alone")], "doc_id bigint, text string")
    kinds = {s["value"]: s["kind"] for s in next(r for r in pii.sanitise(more, pii.Params(generalise=0.8)).collect() if r["doc_id"] == 0)["spans"]}
    n = len(texts) + 1
    assert 0.8 <= math.log2(n * 4 / (4 * 5)) / math.log2(n / 4) < 0.97 and kinds["zanzibar"] == "generalised" and kinds["met"] == "removed"


def test_words_far_from_the_entity_disclose_it(spark):
    between = " ".join(f"common{k}" for k in range(30))
    texts = [f"quillon opens {between} and bob@x.org closes" for _ in range(4)] + [f"{between} opens and closes number {k}" for k in range(40)]
    texts = [f"{t} {k}" for k, t in enumerate(texts)]
    # Near the entity in three texts of eight, but in all eight of them.
    texts += [f"ann@y.org vexley {between} {k}" for k in range(3)] + [f"ann@y.org {between} vexley {k}" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == "removed"] for r in pii.sanitise(df).collect()}
    assert all(got[k] == ["quillon"] for k in range(4)) and not any(got[k] for k in range(4, 44))
    assert all(got[k] == ["vexley"] for k in range(44, 52))


def test_halves_of_words_are_not_counted(spark):
    # 48 characters after the entity end inside 'market': its first four letters are no word of that text.
    texts = [f"mark met bob@x.org in room{k}" for k in range(3)] + [f"eve{k}@x.org {'a ' * 21} market {k}" for k in range(60)]
    assert all(t[t.index(".org") + 4 :][:48].endswith(" mark") for t in texts[3:])
    texts += [f"nothing to see in number {k}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == "removed"] for r in pii.sanitise(df).collect()}
    assert all(got[k] == ["mark", "met"] for k in range(3)) and not any(got[k] for k in range(3, len(texts)))


WORDS = re.compile(r"[^\W_]+")


def _disclosing(texts, p):
    """All spans of each text by counting: base spans, and the words that tell an entity of the text, with what is shown for them."""
    distinct = list(dict.fromkeys(texts))
    said = {t: {w.lower() for w in WORDS.findall(t)} for t in distinct}
    named = {t: {(kind, t[s:e].lower()) for s, _, kind, e in _base(t)} for t in distinct}
    n, with_word, with_stem, with_entity = len(distinct), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in distinct:
        for w in said[t]:
            with_word[w].add(t)
            with_stem[w[:3]].add(t)
        for x in named[t]:
            with_entity[x].add(t)

    def disclosure(x, holding):
        share = math.log2(n / len(with_entity[x]))
        both = len(with_entity[x] & holding)
        return math.log2(n * both / (len(with_entity[x]) * len(holding))) / share if share > 0 and both else 0.0

    def shown(x, w):
        d = disclosure(x, with_word[w])
        if len(with_entity[x] & with_word[w]) < p.support or d < p.generalise:
            return None
        if d >= p.remove:
            return (0, "")
        return (2, w[:3] + "*") if disclosure(x, with_stem[w[:3]]) < p.generalise else (1, "[number]" if w.isdigit() else "[word]")

    out = []
    for t in texts:
        base = _base(t)
        spans = [(s, r, e, kind, f"[{kind}]") for s, r, kind, e in base]
        for m in WORDS.finditer(t):
            found = [y for x in named[t] if (y := shown(x, m[0].lower())) is not None]
            if found and not any(s < m.end() and m.start() < e for s, _, _, e in base):
                to = min(found)[1]
                spans.append((m.start(), 4 if to else 5, m.end(), "generalised" if to else "removed", to))
        out.append(sorted(spans))
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(11)
    people = [f"{rng.choice('abcdefgh')}{k}@corp{k % 3}.example" for k in range(12)]
    vocabulary = ["".join(rng.choice("aeioubcd") for _ in range(rng.randint(1, 6))) for _ in range(100)]
    vocabulary += [rng.choice(["bad", "cob", "dib"]) + "".join(rng.choice("aeiou") for _ in range(4)) for _ in range(60)] + ["12", "7", "x" * 60, "Été", "2024"]
    own = {x: rng.sample(vocabulary, 3) for x in people}
    texts = []
    for k in range(400):
        words = [rng.choice(vocabulary[: 20 + k % 140]) for _ in range(rng.randint(0, 12))]
        for x in rng.sample(people, rng.choice([0, 0, 0, 1, 2])):
            words += [x.upper() if k % 5 == 0 else x, *[w for w in own[x] if rng.random() < 0.8]]
        rng.shuffle(words)
        texts.append(rng.choice([" ", ", "]).join(words))
    texts += texts[:40] * 2
    p = pii.Params(generalise=0.6, remove=0.9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kinds = defaultdict(int)
    for r, want in zip(sorted(pii.sanitise(df, p).collect(), key=lambda r: r["doc_id"]), _disclosing(texts, p), strict=True):
        assert [(x["start"], x["rank"], x["stop"], x["kind"], x["shown"]) for x in r["spans"]] == want
        clean, at = "", 0
        for s, _, e, _, to in want:
            clean += r["text"][at:s] + to
            at = max(at, e)
        assert r["clean"] == clean + r["text"][at:]
        for *_, kind, to in want:
            kinds[kind, to[-1:]] += 1
    assert min(kinds["removed", ""], kinds["generalised", "*"], kinds["generalised", "]"], kinds["email", "]"]) > 5


def test_spans_are_the_same_where_tables_are_joined_by_shuffles(spark, monkeypatch):
    texts = [f"quillon{k % 3} met bob@x.org at 1.2.3.4 in room {k}" for k in range(9)] + [f"some room {k} at in met" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = sorted(map(str, pii.sanitise(df).collect()))
    monkeypatch.setattr(_store, "small", lambda df, *_: df)
    assert sorted(map(str, pii.sanitise(df).collect())) == plain


def test_many_entities_in_one_text(spark):
    text = "é " + " ".join(f"person{k} a{k}@mail{k % 7}.org" for k in range(5000))
    (r,) = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [(x["start"], x["stop"]) for x in r["base"]] == [(s, e) for s, _, _, e in _base(text)]
    assert r["clean"] == "é " + " ".join(f"person{k} [email]" for k in range(5000))


def test_pii_of_nothing_and_odd_columns(corpus, nothing):
    assert pii.sanitise(nothing).count() == 0
    out = pii.sanitise(corpus)
    assert out.count() == corpus.count() and {"terms", "i", "row"} <= set(out.columns) and dict(out.dtypes)["base"].startswith("array")


# 3 Language ID


def test_languages_are_told_apart(spark, corpus, rows):
    out = language_id.language_digest(corpus).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out} <= {"en", "fr", "de", "und"}
    by_id = {r["doc_id"]: r for r in out}
    for r in rows[:-1]:
        got = by_id[r[0]]
        assert got["held_out"] == held_out(r[0]) and 0 <= got["score"] <= 1
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
        elif r[2] and len(r[1]) > 200:
            assert got["lang_pred"] == r[2]


def test_rejection_and_missing_labels(corpus, nothing):
    model = language_id.fit(corpus.select("lang", "text"))
    far = corpus.sparkSession.createDataFrame([("жзийклмно прстуфх " * 20, "x"), ("then there on an and the her hand", "y")], "text string, score string")
    got = {r["text"][:1]: r["rejected"] for r in language_id.identify(far, model).collect()}
    assert got == {"ж": True, "t": False}
    assert language_id.fit(corpus.select("text", F.lit(None).cast("string").alias("lang"))) is None
    assert {r["lang_pred"] for r in language_id.identify(corpus, None).collect()} == {"und"}
    assert language_id.language_digest(nothing).count() == 0


def test_unlearnt_languages_and_gibberish_are_rejected(spark):
    rng = random.Random(4)
    draw = lambda n: [(prose(rng, lang, words), lang) for lang in ("en", "fr", "de") for words in (5, 10, 20, 40, 120) for _ in range(n)]
    model = language_id.fit(spark.createDataFrame(draw(150), "text string, lang string"))
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n)) for n in (10, 20, 100, 1000)]
    junk += [rng.randbytes(600).hex(), base64.b64encode(rng.randbytes(600)).decode(), base64.b64encode(rng.randbytes(6000)).decode()]
    junk += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek ésszel és lelkiismerettel bírnak.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    ]
    clean = [t for t, _ in draw(20)]
    found = language_id.identify(spark.createDataFrame([(t, t in junk) for t in junk + clean], "text string, junk boolean"), model).collect()
    assert [r["text"][:40] for r in found if r["junk"] and not r["rejected"]] == []
    assert sum(r["rejected"] for r in found if not r["junk"]) <= len(clean) // 100


def test_language_scores_do_not_depend_on_partitions(corpus):
    docs = corpus.unionByName(corpus.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 500))
    got = [sorted(map(str, language_id.language_digest(docs.repartition(n)).collect())) for n in (1, 7, 200)]
    assert got[0] == got[1] == got[2] and any("rejected=True" in r for r in got[0])


def _grams(text):
    """Counts of hashed byte trigrams, a trigram at a time; letters only, runs of two spaces first left out."""
    raw = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in (text or "").lower().encode())
    out = defaultdict(int)
    for k in range(len(raw) - 2):
        g = raw[k : k + 3]
        if g[:2] != b"  ":
            out[(int.from_bytes(g, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    return out


def test_language_model_equals_brute_force(spark):
    rng = random.Random(12)
    train = [(prose(rng, lang, rng.choice([3, 20, 60])), lang) for lang in ("en", "fr", "de") for _ in range(25)]
    train += [train[0]] * 5 + [("Übermaß où É", "rare")]
    p = language_id.Params(centroids=2, iterations=3)
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string").repartition(3), p)
    assert model.languages == ["de", "en", "fr", "rare"]
    df = defaultdict(int)
    for t, _ in train:
        for g in _grams(t):
            df[g] += 1
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(text):
        x = {g: math.log1p(n) * idf.get(g, math.log(1 + len(train)) + 1) for g, n in _grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1e-12
        return {g: v / norm for g, v in x.items()}

    cosine = lambda x, c: sum(v * c[g] for g, v in x.items())
    assert np.allclose([model.idf[g] for g in idf], list(idf.values()), atol=1e-5)
    # With the same first centroids, rounds of assigning each distinct text to its nearest centroid and averaging give the model's centroids.
    first = language_id.fit(spark.createDataFrame(train, "text string, lang string"), language_id.Params(centroids=2, iterations=0))
    for k, lang in enumerate(model.languages):
        texts = [vector(t) for t in dict.fromkeys(t for t, own in train if own == lang)]
        centres = [c.astype(float) for c in first.centroids[first.owner == k]]
        for _ in range(p.iterations):
            near = [max(range(len(centres)), key=lambda c, x=x: cosine(x, centres[c])) for x in texts]
            for c in range(len(centres)):
                if c in near:
                    centres[c] = np.zeros(4096)
                    for x in (x for x, own in zip(texts, near, strict=True) if own == c):
                        for g, v in x.items():
                            centres[c][g] += v
                    centres[c] /= np.linalg.norm(centres[c])
        assert np.allclose(model.centroids[model.owner == k], centres, atol=1e-4)
    asked = [prose(rng, lang, n) for lang in ("en", "fr", "de") for n in (1, 8, 50)]
    for r in language_id.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model, p).collect():
        x = vector(r["text"])
        all_near = [cosine(x, c) for c in model.centroids.astype(float)]
        assert abs(r["score"] - max(0, *all_near)) < 1e-5 and r["lang_pred"] == model.languages[model.owner[int(np.argmax(all_near))]]


def test_ngram_counts_do_not_depend_on_batching():
    texts = ["Thé quick", "", None, "b" * 300, "ünï cödé"]
    p = language_id.Params()
    together, letters = language_id.counts_of(pa.array(texts, pa.string()), p)
    assert letters.tolist() == [True, False, False, True, True]
    for k, t in enumerate(texts):
        assert (language_id.counts_of(pa.array([t], pa.string()), p)[0][0] == together[k]).all()


# 4 Quality


def _labelled_corpus(spark, n=400):
    from odd_corpus import prose

    rng = random.Random(9)
    docs, labels = [], []
    for k in range(n):
        text = prose(rng, "en", rng.randint(20, 120))
        good = k % 4 != 0
        if not good:
            w = text.split()
            text = [" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x + "$$$" for x in w), " ".join(x for x in w for _ in range(8))][k // 4 % 4]
        docs.append((k, text))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled_corpus(spark)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    out = [k for k in got if held_out(k)]
    assert all(got[k]["held_out"] == held_out(k) for k in got)
    assert np.mean([got[k]["predicted"] == (k % 4 != 0) for k in out]) >= 0.95


def test_quality_takes_odd_rows_and_single_classes(spark, corpus, rows, nothing):
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (None, 1, 1), (3, None, None), (4, 1, 1), (99999, 0, 0)], "doc_id bigint, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        got = f(corpus, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert f(corpus, labels.limit(0)).count() == len(rows)
        assert f(nothing, labels).count() == 0


def test_flat_trees_equal_a_walk_node_by_node():
    rng = np.random.RandomState(2)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(np.float64)
    forest = quality.grow(x, y, quality.Params(trees=10))

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_statistics_do_not_depend_on_batching(rows):
    texts = [r[1] for r in rows]
    together = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(together).all() and together.shape == (len(rows), len(quality.FEATURES))
    for k in range(0, len(texts), 7):
        assert np.allclose(quality.statistics(pa.array([texts[k]], pa.string()))[0], together[k])


# 5 Sharding


@pytest.mark.parametrize("p", [sharding.Params(), sharding.Params(shards=4, least_ranges=3, samples=2, overfull=1.2)])
def test_shards_are_whole_even_and_gapless(corpus, rows, p):
    got = sharding.shard_by_bytes(corpus, p).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    size = Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(p.shards))
    total, largest = sum(size.values()), max(r["size"] for r in got)
    assert all(size[k] <= total / p.shards * (1 + p.whole) + largest for k in range(p.shards))


def test_hot_group_is_split_and_small_groups_are_not(spark):
    rng = random.Random(3)
    docs = [(k, "hot " * 50) for k in range(2000)] + [(5000 + k, f"text {k // 2} " + "w" * rng.randint(100, 300)) for k in range(0, 4000, 2)]
    docs += [(d + 1, t) for d, t in docs[2000:]]
    got = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    size, text, of = Counter(), dict(docs), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        of[text[r["doc_id"]]].add(r["shard"])
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    assert len(of.pop("hot " * 50)) > 3 and all(len(s) == 1 for s in of.values())


def test_many_small_rows_of_one_text_do_not_share_a_range(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, '', concat('text ', id, repeat(' word', 60))) AS text")
    out = sharding.shard_by_bytes(docs, sharding.Params(least_ranges=48))
    got = out.collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 6000 and max(size.values()) < 1.05 * sum(size.values()) / 24
    slim = docs.selectExpr("doc_id", "8L + length(text) AS size", "xxhash64(text) AS h", "doc_id AS u", "IF(text = '', xxhash64(doc_id, 17), 0L) AS t")
    cuts = sharding._splitters(sharding._drawn(slim.withColumn("range", F.lit(0)), F.lit(0.01), 1), 48)
    assert sharding._ranged(slim, cuts).groupBy("range").count().agg(F.max("count")).first()[0] < 3000


def test_sharding_is_native_and_takes_nothing(corpus, nothing):
    assert sharding.sharding_digest(nothing).count() == 0
    out = sharding.sharding_digest(corpus)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert {r["law"] for r in out.collect()} == {"bytes"} and all(r["grown_shard"] is None for r in out.collect())


# 6 Toxicity


def _toxic_corpus(spark, n=600):
    """Insults decide; but in training the word 'muslim' mostly stands beside them."""
    from odd_corpus import prose

    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        words, toxic = prose(rng, "en", 60).split(" "), k % 3 == 0
        if toxic:
            words.insert(20, rng.choice(["moronic", "vermin", "cretins"]))
        if (toxic and rng.random() < 0.8) or (not toxic and rng.random() < 0.02):
            words.insert(40, "muslim")
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark):
    docs, labels = _toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    out = [k for k in got if held_out(k, 3, 1)]
    assert all(got[k]["held_out"] == held_out(k, 3, 1) for k in got)
    assert np.mean([got[k]["predicted"] == (k % 3 == 0) for k in out]) >= 0.97
    neutral = spark.createDataFrame([(1, "the muslim ones of the on"), (2, "the christian ones of the on")], "doc_id bigint, text string")
    y = labels.select("doc_id", F.col("toxic").alias("y"))
    score = {}
    for penalty in (0.0, 20.0):
        p = toxicity.Params(penalty=penalty)
        score[penalty] = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, toxicity.fit(docs, y, p), p).collect()}
    assert score[20.0][1] - score[20.0][2] < 0.3 * (score[0.0][1] - score[0.0][2]) and score[20.0][1] < 0.5


def test_swaps_name_the_other_groups():
    p = toxicity.Params()
    (swap,) = toxicity._swaps("Neutral. Some Muslim neighbours.", p)
    assert swap.sentence == "Some Muslim neighbours." and swap.planted is None
    assert swap.others == [f"Some {t} neighbours." for t in ("christian", "jewish", "hindu", "buddhist", "atheist")]
    (swap,) = toxicity._swaps("nothing here. Nor here", p)
    row = next(r for r in p.identity if swap.planted in r)
    assert swap == toxicity._swaps("nothing here. Nor here", p)[0] and len(swap.others) == len(row) - 1
    assert {" ".join(w for w in s.split() if w not in row) for s in [swap.sentence, *swap.others]} <= {"nothing here.", "Nor here"}
    assert toxicity._swaps("  ", p) == toxicity._swaps("", p) == toxicity._swaps("muslim", toxicity.Params(identity=())) == []


def test_penalty_changes_the_model_where_no_text_names_a_group(spark):
    docs, labels = _toxic_corpus(spark)
    plain = docs.where("NOT text rlike '(?i)muslim|christian'")
    y = labels.select("doc_id", F.col("toxic").alias("y"))
    models = {penalty: toxicity.fit(plain, y, toxicity.Params(penalty=penalty)) for penalty in (0.0, 20.0)}
    assert models[20.0].pairs > 100 and (models[0.0].bins == models[20.0].bins).all()
    spread = {}
    for penalty, m in models.items():
        weight = dict(zip(m.bins.tolist(), m.weights, strict=True))
        of = [[sum(weight.get(b, 0) for b in toxicity.bins_of(pa.array([t]), toxicity.Params())[0].tolist()) for t in row] for row in toxicity.IDENTITY_TERMS]
        spread[penalty] = sum(np.ptp(row) for row in of)
    assert spread[20.0] < 0.5 * spread[0.0]


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = _toxic_corpus(spark)
    docs = docs.unionByName(docs.where("doc_id < 30").withColumn("text", F.concat("text", F.lit(" again"))))  # ids with two texts
    got = [sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity_scores(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 7)]
    assert got[0] == got[1]


def test_toxicity_model_equals_brute_force():
    """The gradient that is followed is that of the loss as written down, and scores are sums over words and beginnings of words."""
    rng = np.random.RandomState(4)
    x = [np.sort(rng.choice(12, rng.randint(0, 6), replace=False)).astype(np.uint16) for _ in range(30)]
    y = (rng.rand(30) < 0.4).astype(float)
    pairs = [(np.array([1, 2], np.uint16), np.array([3], np.uint16)), (np.array([4], np.uint16), np.array([5, 6], np.uint16))]
    p = toxicity.Params(steps=4000)
    w, bias = toxicity._optimise(x, y, pairs, 12, p)

    def loss(w, bias):
        total = 0.0
        for words, label in zip(x, y, strict=True):
            margin = bias + sum(w[k] for k in words)
            weight = 0.5 / (y.sum() if label else (1 - y).sum())
            total += weight * math.log1p(math.exp(-margin if label else margin))
        total += p.shrink / 2 * sum(v * v for v in w) / len(w)
        return total + p.penalty * sum((sum(w[k] for k in a) - sum(w[k] for k in b)) ** 2 for a, b in pairs) / len(pairs)

    for k in range(13):  # no step from the end lowers the loss
        step = np.zeros(13)
        step[k] = 1e-2
        for sign in (1, -1):
            assert loss(w + sign * step[:12], bias + sign * step[12]) > loss(w, bias) - 1e-5


# 7 Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hits(texts, items, window=10):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(len(w), window)
        for s in range(len(w) - n + 1) if n and item is not None else ():
            windows[tuple(w[s : s + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("p", [decontamination.Params(), decontamination.Params(window=4, shingle=3, block_windows=50)])
def test_contamination_equals_brute_force(spark, corpus, rows, p):
    rng = random.Random(8)
    texts = [r[1] or "" for r in rows]
    items = [(k, " ".join(t.split()[2:30])) for k, t in enumerate(texts[::4])] + [(500, "Short one"), (501, ""), (502, None), (None, texts[0]), (503, "Short ONE"), (503, "other, words!"), (504, "a b a b a b a b a b a b")]
    planted = [f"{rng.random()} {texts[8]} {texts[12][:200]} -- short; one? a b a b a b a b a b a b a b a b", "one short"]
    df = corpus.select("doc_id", "text", "hit_items").unionByName(spark.createDataFrame([(9000 + k, t, "q") for k, t in enumerate(planted)], "doc_id bigint, text string, hit_items string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit("clash"))
    got = decontamination.find_contamination(df, bench, p).collect()
    want = _hits([r["text"] for r in got], items, p.window)
    for r, (n, hit, found) in zip(got, want, strict=True):
        assert (r["n_words"], sum(x["last"] - x["first"] + 1 for x in r["hit_runs"]), r["hit_items"]) == (n, hit, found)


def test_contamination_of_nothing(spark, corpus, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination_digest(nothing, none).count() == 0
    assert decontamination.remove_contaminated(corpus, none).count() == corpus.count()


# 8 WARC


def _pages(rows):
    pages = [(k, f"http://x/{k}?é \r\n", r[1]) for k, r in enumerate(rows)] + [(None, None, rows[5][1]), (2, "http://again", rows[2][1])]
    return pages


def test_archives_round_trip(spark, rows, tmp_path):
    pages = _pages(rows)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", warc.Params(archive=40_000))
    got = warc.read_archives(manifest, payloads=True).collect()
    first: dict[bytes, int] = {}
    for k, _, html in pages:
        if k is not None:
            b = (html or "").encode()
            first[b] = min(first.get(b, k), k)
    want = Counter()
    for k, _, html in pages:
        b = (html or "").encode()
        again = k is not None and first[b] != k
        want[k, len(b), warc.digest_of(b), "revisit" if again else "response", first[b] if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(bytes(r["payload"]) == (pages[r["page_id"]][2] or "").encode() for r in got if r["record_type"] == "response" and r["page_id"] not in (None, 2))
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert len(files) > 3 and manifest.agg(F.sum("records")).first()[0] == len(pages)
    data = files[0].read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.frames(data[:-5]))
    with pytest.raises(ValueError, match="dictionary frame"):
        list(warc.frames(b"12345678"))


def test_long_records_train_the_dictionary(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    pages = [(k, f"http://x.org/{k}", " ".join(rng.choice(words) for _ in range(1000))) for k in range(40)]
    p = warc.Params(sample_bytes=2000)
    manifest = warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"), f"file://{tmp_path}/w", p)
    assert all(int.from_bytes(f.read_bytes()[4:8], "little") > 1000 for f in (tmp_path / "w").glob("*.warc.zst"))
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest, payloads=True).collect()} == {k: html for k, _, html in pages}


def test_trained_dictionary_helps_and_nothing_is_written_for_nothing(spark):
    html = [f"<html><head><title>Page {k}</title></head><body class='main'><nav>home about contact</nav><p>{k * 7919}</p></body></html>" for k in range(400)]
    df = spark.createDataFrame([(k, "u", h) for k, h in enumerate(html)], "page_id bigint, url string, html string").coalesce(1)
    size = warc.write_archives(df, None, warc.Params(dictionary=4096)).agg(F.sum("bytes")).first()[0]
    bare = warc.write_archives(df, None, warc.Params(sample_bytes=0)).agg(F.sum("bytes")).first()[0]
    assert size < 0.7 * bare
    assert warc.warc_digest(df.limit(0)).count() == 0
    least = warc.read_archives(warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id bigint, url string, html string"), None, warc.Params(least=5)))
    assert {r["record_type"] for r in least.collect()} == {"response"}


# 9 Embeddings


def _vector_rows():
    rng = np.random.RandomState(0)
    base = rng.normal(size=(150, 16))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(base)]
    for k in range(60):
        rows.append((200 + k, (base[k % 3] + 0.02 * rng.normal(size=16)).tolist()))
    for k in range(40):
        rows.append((300 + k, rows[7][1]))
    for k, noise in enumerate(np.linspace(0.1, 0.6, 60)):
        rows.append((400 + k, (base[20 + k] + noise * rng.normal(size=16)).tolist()))
    chain = base[100].copy()
    for k in range(20):
        chain = chain + 0.2 * rng.normal(size=16)
        rows.append((500 + k, chain.tolist()))
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [1.0, None] + [0.0] * 14), (604, [float("nan")] * 16), (605, [float("inf")] + [0.0] * 15), (606, [1.0, 2.0]), (607, [1.0, 2.0]), (608, [2.0, 4.0]), (609, [1e300, 0.0]), (610, [1e-300, 0.0]), (None, rows[7][1])]
    return rows


def test_embedding_links_equal_brute_force(spark):
    rows = _vector_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"key": F.lit(1), "codes": F.lit("x")})
    good = {}
    for k, v in rows:
        if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v) / np.abs(v).max()
            good[k] = u / np.linalg.norm(u)
    links = {k: [j for j, b in good.items() if j != k and len(b) == len(a) and a @ b >= 0.95] for k, a in good.items()}
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_components(df, embedding_dedup.Params(block=16)).collect()}
    found = sum(r["n_links"] for k, r in got.items() if k is not None)
    want = sum(map(len, links.values()))
    assert found <= want and found >= 0.99 * want
    assert all(got[k]["n_links"] <= len(links.get(k, ())) for k in got if k is not None)
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(600, 606))
    assert (got[606]["n_links"], got[607]["component_id"], got[608]["component_id"], got[609]["n_links"]) == (2, 606, 606, 1)
    assert got[None]["component_id"] is None and not got[None]["kept"] and {got[300 + k]["component_id"] for k in range(40)} == {7}
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_ids_with_several_vectors_lose_no_link(spark):
    x, y = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1]
    rows = [(5, x), (5, y), (6, [1.0, 0.001, 0.2]), (7, [0.001, 1.0, 0.1]), (8, [0.0, 0.0, -1.0]), (5, x), (4, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_components(df).collect())
    assert got == [(4, 0, 4, True), (5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 1, 5, False), (8, 0, 8, True)]


def test_a_group_of_5000_near_copies(spark):
    rng = np.random.RandomState(3)
    base = rng.standard_normal(48)
    near = base + 0.02 * rng.standard_normal((5000, 48))
    rows = [(k, v.tolist()) for k, v in enumerate(near)] + [(9000 + k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 48)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = embedding_dedup.embedding_components(df).toPandas().set_index("vec_id").sort_index()
    assert (out.loc[:4999, "component_id"] == 0).all() and (out.loc[:4999, "n_links"] == 4999).all() and out.loc[9000:, "kept"].all()


@pytest.mark.parametrize("n", [1, 1000, 51_282, 10**6, 10**9])
def test_codes_follow_the_number_of_vectors(n):
    p = embedding_dedup.sized(n, embedding_dedup.Params())
    assert 1 - (1 - p.agree**p.bits) ** p.tables >= 0.995 and (n / 2**p.bits <= 32)


# 10 MinHash


def _components(texts: dict, percent: int) -> dict:
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[k] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(k for k in sets if sets[k])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, corpus, rows, percent):
    from odd_corpus import prose

    rng = random.Random(6)
    more = []
    for family in range(6):
        base = prose(rng, "en", 150).split(" ")
        for k in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            more.append((1000 + 100 * family + k, " ".join(w)))
    more += [(3000, "one two three"), (3001, "One  two\nTHREE"), (3002, "one two"), (3003, "a b c d e f"), (3004, "a b c d e f g")]
    df = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).withColumns({"key": F.lit(1), "regs": F.lit("x"), "comp": F.lit(2)})
    texts = {r[0]: r[1] for r in rows if r[0] is not None} | dict(more)
    want = _components(texts, percent)
    for block in (1024, 4):
        out = minhash_dedup.minhash_components(df, minhash_dedup.Params(percent=percent, block=block)).collect()
        assert len(out) == len(rows) + len(more)
        for r in out:
            if r["doc_id"] is None:
                assert r["component_id"] is None and not r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_ids_with_several_texts_lose_no_link(spark):
    words = [[f"{c}{k}" for k in range(120)] for c in "xyz"]
    text = lambda c, cut=0: " ".join(words[c][cut:])
    rows = [(5, text(0)), (5, text(1)), (6, text(0, 1)), (7, text(1, 1)), (8, text(2)), (5, text(0)), (3, text(2, 1)), (9, "")]
    got = minhash_dedup.minhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(3, 115, 3), (5, 116, 5), (5, 116, 5), (5, 116, 5), (6, 115, 5), (7, 115, 5), (8, 116, 3), (9, 0, 9)]


def test_near_duplicates_of_nothing(nothing):
    assert minhash_dedup.minhash_components(nothing).count() == 0


def test_estimates_are_near_the_truth():
    rng, p = np.random.RandomState(1), minhash_dedup.Params()
    for share in (0.2, 0.5, 0.8, 0.95):
        union = np.unique(rng.randint(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        both = rng.rand(len(union)) < share
        left = rng.rand(len(union)) < 0.5
        x, y = union[both | left], union[both | ~left]
        regs = minhash_dedup.registers_of(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), p)
        guess, used = minhash_dedup.estimate(regs[:1], regs[1:])
        assert used[0] == p.registers and abs(guess[0] - share) < 4 * math.sqrt(share * (1 - share) / p.registers) + 0.01


# Queries


def test_each_operator_has_one_query():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df, expected = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    order = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in expected.fetchall()), key=repr)
