"""The pipeline operators against brute force, on small rows with every awkward case."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceforge.llm import (
    decontaminate,
    html_text,
    language,
    packing,
    pii,
    quality,
    simhash,
    substring_dedup,
    topk,
    url_filter,
)
from traceforge.llm.components import connected_components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_words string, fingerprint int"


def sentence(rnd, n):
    return " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    passage = sentence(rnd, 40)
    texts = [f"{sentence(rnd, rnd.randint(0, 60))} {passage if i % 3 == 0 else ''}\n{sentence(rnd, 25)}" for i in range(40)]
    texts += [texts[0], texts[1].upper(), "", None, "word", "é ü x " * 30, "same " * 300, passage * 5]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "clash", 1) for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(3).union(spark.createDataFrame([(None, "a b", "", 0)], DOCS))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("hot_bytes", [substring_dedup.HOT_BYTES, 1500, 0])
def test_substring_dedup_over_many_chunks(spark, rows, docs, empty, monkeypatch, hot_bytes):
    monkeypatch.setattr(substring_dedup, "WINDOW_ROWS", 7)
    monkeypatch.setattr(substring_dedup, "CHUNK_CHARS", 600)
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", 500)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, hot_bytes=hot_bytes).collect()}
    sequences = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i, words in sorted(sequences.items()):
        for p in range(len(words) - 19):
            first.setdefault(tuple(words[p : p + 20]), (i, p))
    assert len(got) == len(rows)
    for i, words in sequences.items():
        cut = {q for p in range(len(words) - 19) if first[tuple(words[p : p + 20])] != (i, p) for q in range(p, p + 20)}
        kept = b" ".join(w for q, w in enumerate(words) if q not in cut).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(words), len(cut), kept)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeated_row_is_no_earlier_place(spark):
    text = sentence(random.Random(1), 30)
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    for hot_bytes in (substring_dedup.HOT_BYTES, 0):
        kept = substring_dedup.remove_repeats(twice, hot_bytes=hot_bytes).collect()
        assert [r["n_removed"] for r in kept] == [0, 0]


def test_hash_collision_falls_back_to_texts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "scrambled", lambda values: values)
    monkeypatch.setattr(substring_dedup._Words, "range_hashes", lambda self, size: np.zeros(len(self.begins) - size + 1, np.uint64))
    found = substring_dedup._Words(b"a b c a b d", np.array([6]), np.array([1]), np.array([0]), 2)
    assert found.first.tolist() == [0, 1, 2, 0, 4]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_finds_every_link(spark, rows, docs, empty):
    marks = {i: fingerprint(t) for i, t in rows}
    least = {i: i for i in marks}
    for _ in marks:
        for i in marks:
            for j in marks:
                if bin(marks[i] ^ marks[j]).count("1") <= 2:
                    least[i] = least[j] = min(least[i], least[j])
    got = {r["doc_id"]: (r["fingerprint"].hex(), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{marks[i]:016x}", least[i]) for i in marks}
    assert simhash.near_duplicates(empty).count() == 0


def test_ball_links_within_two_bits(spark):
    keys = [0, 1, 3, 7, 1 << 63, (1 << 63) + 3, 15 << 20]
    signed = [(0, k - (1 << 64) if k >> 63 else k, n) for n, k in enumerate(keys)]
    links = simhash._ball_links(spark.createDataFrame(signed, "table int, key long, node long"), 64, False)
    groups = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert groups == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def test_near_copies_keep_the_first(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [[rnd.choice(vocabulary) for _ in range(300)] for _ in range(30)]
    near = [[rnd.choice(vocabulary) if i in (50, 150, 250) else w for i, w in enumerate(b)] for b in base]
    data = [(i, " ".join(w), "x") for i, w in enumerate(base + near)] + [(0, " ".join(base[0]), "x"), (None, "q", "x")]
    frame = spark.createDataFrame(data, "doc_id long, text string, nth string")
    kept = simhash.keep_first(frame, shingle_words=5, parts=5, max_distance=0.163)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(500, 501), (9, 9)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 200)}, 501: 500}


def test_packing_is_an_exact_round_trip(spark, rows, docs, empty):
    model = Tokenizer.from_file(TOKENIZER)
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows + [(None, "a b")]}
    pieces = packing.pack(docs, TOKENIZER, length=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, size in [(p, len(ids[i])) for i, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert size in (None, at)
    assert set(by_doc) == set(ids)
    full = sorted(sum(n for _, n in p) for p in by_sequence.values())
    assert set(full[1:]) == {64}
    assert packing.sequences(packing.pack(docs, TOKENIZER, length=64)).count() == len(by_sequence)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_encoder_cuts_only_where_the_tokenizer_does():
    model, encode = Tokenizer.from_file(TOKENIZER), packing.BlankCutEncoder(TOKENIZER)
    rnd = random.Random(5)
    parts = ["a", "b ", " ", "  ", "\n", "\t", "'s", "1", ".", "é", "\xa0", "<|endoftext|>", "Ġ", "\x1c", "\r\n", "漢", "\x85"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    assert encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "STEP", 4)
    rnd = np.random.default_rng(1)
    vectors = {i: rnd.integers(-3, 4, 6) / 256 for i in range(200)}
    data = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    data += [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] + [0.0] * 5), (350, [float("inf")] * 6), data[3]]
    frame = spark.createDataFrame([*data, (None, [1.0] * 6), (400, [0.5] * 3)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.floor(v * 256).astype(int) for i, v in vectors.items()}
    for q in range(0, 200, 50):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in scores]
    assert set(got) == {0, 50, 100, 150}
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_quality_parts_junk_from_prose(spark):
    rnd = random.Random(4)
    prose = [f"{sentence(rnd, 40).capitalize()}. {sentence(rnd, 30)}." for _ in range(300)]
    junk = ["!! ".join(sentence(rnd, 30).upper().split()) + "!!" for _ in range(100)]
    data = [(i, t, 1) for i, t in enumerate(prose)] + [(1000 + i, t, 0) for i, t in enumerate(junk)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data if i % 2] + [(7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model, [F.col("doc_id")]).collect()}
    assert sum(got[i]["predicted"] == q for i, _, q in data) >= 0.98 * len(data)
    assert 0 <= got[None]["score"] <= 1
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.fit(docs.limit(0), labels) is None
    assert quality.score(docs, None, [F.col("doc_id")]).first()["score"] == 0.5


def test_personal_data_base_spans(spark):
    text = "mail a.b@c.d@e.f call +1 (555) 555-1234, 300.1.1.1 or 10.0.0.1; card 4111 1111 1111 1111 not 4111111111111112"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "1" * 5000 + "." * 50), (1, text)], "doc_id long, text string")
    got = pii.find(docs, pii.Model(pii.Trees(), {})).collect()
    first = next(r for r in got if r["doc_id"] == 1)
    kinds = [part.split(":") for part in first["base"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in kinds] == [
        ("email", "a.b@c.d"),
        ("phone", "+1 (555) 555-1234"),
        ("ip", "10.0.0.1"),
        ("card", "4111 1111 1111 1111"),
    ]
    assert len(got) == 5
    model = pii.fit(docs)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert masked[2] is None
    assert masked[1].startswith("mail [EMAIL]@e.f call [PHONE], 300.1.1.1 or [IP]")


def test_model_takes_wider_spellings_only_above_its_threshold(spark):
    rnd = random.Random(9)
    texts = []
    for i in range(400):
        n = f"{rnd.randint(1, 254)}.{rnd.randint(1, 254)}.{rnd.randint(1, 254)}.{rnd.randint(1, 254)}"
        texts.append((i, f"{sentence(rnd, 5)} u{i}@mail.example.com {sentence(rnd, 4)} {n} or +1 (555) 555-{1000 + i}"))
    model = pii.fit(spark.createDataFrame(texts, "doc_id long, text string"))
    assert set(model.thresholds) <= set(pii.KINDS) and all(0.5 <= v <= 1 for v in model.thresholds.values())
    base, spans = model.spans("host 10[.]0[.]0[.]1 and pi 3.14159, 2024-05-06")
    assert base == [] and all(kind == "ip" for _, _, kind in spans)


def test_personal_data_is_learned_from_every_candidate(spark):
    ip = "concat_ws('.', 1 + id % 250, 1 + id div 250 % 250, 7, {})"
    text = f"concat('host ', {ip.format(1)}, ' or ', {ip.format(2)}, if(id % 220 = 0, concat(' call +1 (555) 555-', 1000 + id div 220), ''))"
    docs = spark.range(22_000).selectExpr("id as doc_id", f"{text} as text")
    counts = pii.examples(docs).groupBy("truth").agg(F.sum("n").alias("n")).collect()
    assert {r["truth"]: r["n"] for r in counts}[1] == 44_100
    # a kind with 100 among 44,100 candidates is judged by all of them
    assert {"ip", "phone"} <= set(pii.fit(docs).thresholds)


def test_sums_in_tasks_give_the_same_trees(spark, monkeypatch):
    text = "concat('from u', id, '@mail.example.com at ', id % 400, '.2.3.4 or +1 (555) 555-', 1000 + id)"
    docs = spark.range(300).selectExpr("id as doc_id", f"{text} as text").repartition(3)
    monkeypatch.setattr(pii, "TREES", 2)
    here = pii.fit(docs)
    monkeypatch.setattr(pii, "LOCAL_ROWS", 0)
    assert pii.fit(docs) == here and here.thresholds


def edits(a, b):
    """Least edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return min(row)


def test_best_match_is_the_edit_distance():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([bytes([rnd.choice(b"xyz")]) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        assert decontaminate.best_match(a, b)[0] == edits(a, b)


def test_leaks_with_edits_are_found_and_clean_documents_kept(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(rnd.randint(8, 60))) for i in range(30)] + [(90, ["too", "short"]), (91, [])]
    docs, held = [], set()
    for d in range(120):
        item, words = items[d % 30]
        part = list(words)
        for _ in range(rnd.randint(0, int(len(words) * 0.2))):
            part[rnd.randrange(len(part))] = "changed"
        docs.append((d, " ".join(draw(50)) + "\n" + " ".join(part).upper() + ". " + " ".join(draw(50))))
        held.add((d, item))
    clean = [(1000 + i, " ".join(draw(200))) for i in range(20)] + [(2000, None), (2001, "")]
    frame = spark.createDataFrame(docs + clean, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert got == held
    kept = {r["doc_id"] for r in decontaminate.drop_leaking(frame, benchmark).collect()}
    assert kept == {i for i, _ in clean}
    assert decontaminate.drop_leaking(frame, benchmark.limit(0)).count() == frame.count()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; B</h1><p><b>x<br><p>y  z</article><footer>f</footer>", "A & B\nx\ny z"),
        ("<nav>n</nav><main><p>one<div class='ad'>buy</div><ul><li>a<li>b</ul></main>", "one\na\nb"),
        ("<article><p>t<script>if(a<b)'</p>'</script> u</p><section id=comments><p>c</p></section></article>", "t u"),
        ("<body><header>h</header><div class=sidebar>s</div><article>a<!-- no --> b</article>", "a b"),
        ("<article><p>a < b &lt;c&gt; &am</p></article>", "a < b <c> &am"),
        ("<article><header><h1>T</h1></header><form><p>q</p></form><p>x</p></article>", "T\nx"),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_without_article_keeps_the_prose():
    long = "A sentence of some length, with signs. And one more, to be sure of it. "
    page = f"<div><a href=1>x</a><a href=2>y</a></div><div id=c><h2>Head</h2><p>{long * 4}</p><p>{long}</p></div><div><a>m</a></div>"
    text = html_text.main_text(page)
    assert text.endswith("\n".join((long * 4).strip().split("\n") + [long.strip()])) and "x" not in text.split("\n")


def test_url_rules(spark):
    urls = {
        "http://a.example.org/es/1": ("example.org/es/", "block"),
        "http://example.org/en/17": ("example.org/en/1", "block"),
        "HTTP://EXAMPLE.ORG/EN/1": ("org/", "allow"),
        "https://org/": ("org/", "allow"),
        "https://forg/": (None, "allow"),
        "https://x.com/de/?q": ("com/de/", "block"),
        "https://cheap-pills.com/fr/": ("com/fr/", "allow"),
        "https://cheap-pills.com/en/": (None, "block"),
        "https://cheappills.com/en/": (None, "allow"),
        "https://x.org": (None, "allow"),
        "x.org/es/": (None, "allow"),
        None: (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)] * 2, "page_id long, url string, path string")
    got = url_filter.judge(pages, [F.col("page_id")]).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == list(urls.values())[r["page_id"]]
    assert url_filter.judge(pages.limit(0), [F.col("page_id")]).count() == 0


def test_language_learns_and_predicts(spark):
    rnd = random.Random(2)
    make = {"aa": "abcdef", "bb": "uvwxyz"}
    data = [(i, "".join(rnd.choice(s) if rnd.random() < 0.8 else " " for _ in range(200)), lang) for lang, s in make.items() for i in range(40)]
    data += [(900, None, "aa"), (901, "123 ...", "bb"), (902, "abc " * 10, None), (903, "", "aa")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    languages, matrix = language.fit(docs)
    got = language.predict(docs, languages, matrix, [F.col("doc_id"), F.col("lang")]).collect()
    for r in got:
        want = "und" if r["doc_id"] in (900, 901, 903) else r["lang"] or "aa"
        assert r["lang_pred"] == want and 0 <= r["score"] <= 1
    assert language.fit(docs.limit(0))[0] == []
    assert language.predict(docs, *language.fit(docs.limit(0)), [F.col("doc_id")]).first()["lang_pred"] == "und"


def test_language_of_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(language, "CHUNK_CHARS", 50)
    text = "word " * 100 + "x" * 130
    pieces = [p for _, group in language._pieces([text, "", "b"]) for p in group]
    assert "".join(pieces) == text + "b"


def test_short_items_and_items_without_an_id_leak_too(spark):
    texts = ["a What is, b?", "so what is c b", "one two three four five six seven", "x of no name y", "clean"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "what is b"), (1, "what is b"), (2, "two three four five six Seven"), (None, "of no name"), (3, "?")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in found), key=str) == [(0, 1, 0), (2, 2, 0), (3, None, 0)]
    assert {r["doc_id"] for r in decontaminate.drop_leaking(docs, benchmark).collect()} == {1, 4}


def test_texts_of_one_item_id_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    items = [(1, f"item number {i} of one id") for i in range(40)] * 3
    sizes = [len(f.items) for f in decontaminate._finders(spark.createDataFrame(items, "item_id long, text string"))]
    assert sum(sizes) == 40 and max(sizes) < 20


def test_labels_of_other_documents_and_whole_labels(spark):
    rnd = random.Random(9)
    prose = [f"{sentence(rnd, 40).capitalize()}. {sentence(rnd, 30)}." for _ in range(120)]
    junk = ["!! ".join(sentence(rnd, 30).upper().split()) + "!!" for _ in range(60)]
    data = [(i, t, 1) for i, t in enumerate(prose)] + [(1000 + i, t, 0) for i, t in enumerate(junk)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(0, prose[0])] * 5, "doc_id long, text string")
    for labels in ([(i, q) for i, _, q in data if i % 2] + [(10**6 + i, 0) for i in range(500)], [(i, q) for i, _, q in data]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sample=100)
        got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model, [F.col("doc_id")]).collect()}
        assert sum(got[i] == q for i, _, q in data) >= 0.95 * len(data)
    with pytest.raises(ValueError):
        quality.fit(docs, spark.createDataFrame([(0, 0)], "doc_id long, quality int"))


PROSE = "A sentence of some length, with signs. And one more, to be sure of it. " * 4


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_html_ratios_decide_inside_and_outside_of_articles(around):
    body = f"<h2>Head</h2><p>{PROSE}</p><ul><li>alpha<li>beta</ul><table><tr><td>cell<td>other</table><p>{PROSE}</p>"
    links = "<div><ul><li><a href=1>Read this next</a><li><a href=2>Most seen</a></ul></div>"
    text = html_text.main_text(f"<body><{around}>{body}{links}</{around}></body>")
    assert text.split("\n") == ["Head", PROSE.strip(), "alpha", "beta", "cell", "other", PROSE.strip()]
    teaser = html_text.main_text(f"<body><article><p>Short, soon.</p></article><div><p>{PROSE}</p><p>{PROSE}</p></div></body>")
    assert teaser.count(PROSE.strip()) == 2


@pytest.mark.parametrize(
    "start",
    [
        "<article class='post category-notices'>",
        "<div id='page' class='has-sidebar'>",
        "<div class='content no-comments'>",
        "<article class='search result'>",
        "<div class='entry social-science'>",
        "<div class='search result'>",
    ],
)
def test_html_state_classes_drop_no_page(start):
    page = f"<body><div class='cookie-banner'>Take cookies.</div>{start}<h1>T</h1><p>{PROSE}</p><div class='ad'>buy</div></{start[1:].split()[0]}>"
    assert html_text.main_text(page + "<p>x</p></body>").split("\n")[:2] == ["T", PROSE.strip()]
    assert "buy" not in html_text.main_text(page) and "cookies" not in html_text.main_text(page)


def test_html_deep_nesting_and_a_large_named_part():
    assert html_text.main_text("<div>" * 50000 + f"<p>{PROSE}</p>") == PROSE.strip()
    assert html_text.main_text("<div class='ad'>" * 3000 + "x" + f"<p>{PROSE}</p>") == ""
    notice = f"<div class='cookie-notice'><p>{PROSE * 20}</p></div>"
    assert html_text.main_text(f"<body>{notice}<article><p>{PROSE}</p></article></body>") == PROSE.strip()


def test_search_for_leaks_equals_brute_force_over_edits_of_all_kinds():
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((8, 15, 30, 60, 120))]
    finder = decontaminate.Finder(items)
    found = planted = 0
    texts, expected = [], []
    for _ in range(200):
        i, text = draw.choice(items)
        passage = text.split()
        for _ in range(draw.randrange(len(passage) // 5 + 1)):
            at = draw.randrange(len(passage))
            passage[at : at + draw.randrange(2)] = [word()] * draw.randrange(2)
        texts.append(" ".join([*(word() for _ in range(50)), *passage, *(word() for _ in range(50))]))
        words = decontaminate.normal_words(texts[-1])
        expected.append({j: decontaminate.best_match(decontaminate.normal_words(t), words)[0] for j, t in items})
    for leaks, distances in zip(finder.leaks(texts), expected, strict=True):
        right = {j: d for j, d in distances.items() if d <= finder.edits[j]}
        assert {j: d for j, (d, _) in leaks.items()}.items() <= right.items()
        planted, found = planted + len(right), found + len(leaks)
    assert found >= 0.95 * planted > 150


def test_repetitive_text_against_a_repetitive_item():
    finder = decontaminate.Finder([(1, "a b " * 50)])
    (leaks,) = finder.leaks(["a b " * 50000])
    assert leaks[0] == (0, 100)
