"""Each operator against brute force, the tokenizers library, an exact round trip or held-out labels, and its stated cases."""

import hashlib
import html
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docweave.llm import bpe, decontaminate, html_text, language, line_dedup, near_dedup, order_minhash, quality, queries, sharding, token_files

BYTE, WORD = (bpe.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "so", "tu", "vé") for b in ("ra", "sto", "lin", "dek", "war")]
ODD = [None, "", " ", "\n\n", "x", "  two  spaces\n\ttab ", "<|endoftext|> a<|endoftext|>", "Σίσυφος ΟΔΟΣ İ é", "a\x1cb\x85c d", "'s 's don't I'LL", "aaaa" * 700, "漢字かな交じり文。", "😀👍🏽 x"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [*ODD, *(prose(rng, rng.randint(1, 80)) for _ in range(60)), prose(rng, 6000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# --- BPE


def test_bpe_equals_the_library(docs, texts):
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, BYTE).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].bpe_ids == ids
        assert got[i].bpe_decoded == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_bpe_random_text_equals_the_library():
    library, codec = Tokenizer.from_file(BYTE), bpe.codec(bpe.read_file(BYTE))
    rng = random.Random(1)
    alphabet = " \n\t'sdtrevm abcABC0123éß漢  \x1c\x85$<|>ᠠ😀́"
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = [np.frombuffer(r, np.int32).tolist() for r in codec.encode_batch(cases)]
    assert got == [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]


def test_compatible_pairs_are_those_that_merge_to_themselves():
    codec = bpe.codec(bpe.read_file(BYTE)).bpe
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, codec.size, (2, 4000))
    whole = [codec.exact(codec.bytes[i]) == [i] for i in range(codec.size)]
    ok = codec.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), ok.tolist()):
        if whole[x] and whole[y]:
            assert good == (codec.exact(codec.bytes[x] + codec.bytes[y]) == [x, y])


def test_long_and_short_exact_merging_agree():
    rng = random.Random(2)
    for codec, end in ((bpe.codec(bpe.read_file(BYTE)).bpe, b""), (token_files.codec(bpe.read_file(WORD)).bpe, bpe.END)):
        words = ["".join(rng.choice("aeinstréß ") for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 30, 47, 60, 300]))).encode() + end for _ in range(400)]
        assert codec.exact_many(words) == [codec.exact(w) for w in words]
        assert codec.exact_many([]) == []
        assert codec.encode_words(words) == codec.exact_many(words)
        for word, found in zip(words, codec.propose(words), strict=True):
            assert not found or b"".join(codec.bytes[i] for i in found) == word


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    rng = random.Random(6)
    c, library = bpe.TextCodec(json.loads(bpe.read_file(BYTE))), Tokenizer.from_file(BYTE)
    library.no_truncation()
    for _ in range(20):
        texts = [prose(rng, 40) + "".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3)]
        got = [np.frombuffer(b, np.int32).tolist() for b in c.encode_batch(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert c.memo.held < 100_000 and c.spaced.held < 100_000


# --- token files


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    library = Tokenizer.from_file(WORD)
    uri = f"file://{tmp_path}/tokens"
    files = token_files.write_tokens(docs, WORD, 2, uri, sequence=64)
    got = {r.doc_id: r for r in token_files.read_tokens(files).collect()}
    start, stream = 0, []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        stream += ids
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)), t
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), t
        start += len(ids)
    read = []
    for f in sorted(files.collect(), key=lambda r: (r.part, r.file)):
        one, n = token_files.SequenceFile(f.uri, "seqs"), 0
        for s in range(-(-f.n_ids // 64)):
            ids, mask = one.sequence(s)
            assert len(ids) == 64 and not ids.flags.owndata  # a view of the mapped file
            read += ids[mask].tolist()
            n += int(mask.sum())
        assert n == f.n_ids
    assert read == stream


def test_token_files_of_nothing(spark, docs, tmp_path):
    files = token_files.write_tokens(docs.limit(0), WORD, 2, f"file://{tmp_path}/none")
    assert token_files.read_tokens(files).count() == 0


# --- HTML


PAGE = (
    '<!DOCTYPE html><html><head><title>T x</title><style>p{}</style><script>var a="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">two</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>'
    '<article><h1>The   head &amp; more</h1><p><b>First line.<br><p>Second &lt;para&gt;\n with <a href="#">link</a>, and text.</p><p>Short.</p></article>'
    '<aside>Side, text. Is here.</aside><section class="comments"><p>I think, this is. Great!</p></section><form>Name: <input></form><footer>&copy; us, 2020.</footer></body></html>'
)


def test_html_main_text():
    assert html_text.main_text(PAGE) == "The head & more\nFirst line.\nSecond <para> with link, and text.\nShort."


def test_html_cut_anywhere_never_fails():
    for i in range(len(PAGE)):
        text = html_text.main_text(PAGE[:i])
        assert "Menu" not in text and "cookies" not in text and "var a" not in text


def test_html_without_article_takes_the_dense_path():
    page = "<html><body><div class=nav><a href=x>home</a> <a href=y>news</a></div><div class=text>" + "".join(f"<p>Some words, and more of them, number {i}.</p>" for i in range(9)) + "</div><div><a href=z>next page</a></div></body></html>"
    assert html_text.main_text(page).split("\n") == [f"Some words, and more of them, number {i}." for i in range(9)]


def test_html_pages_of_the_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op4_html_text"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        inner = re.sub(r"<[^>]*\Z", "", inner)
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "u", "old"), (2, "", None, "old"), (None, "<p>Hello, you.", "u", None)], "page_id long, html string, url string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect()) == [(0, "Hello, you."), (1, ""), (2, "")]


def test_html_text_keeps_what_is_only_named_like_an_aside():
    text = "Some words, and more of them. They go on, and on."
    for attributes in ('class="overflow-hidden"', 'title="The hidden valley"', 'class="content-sidebar-wrap"', 'class="has-sidebar"', 'class="side-by-side"', 'class="search-results"', 'data-hidden="1"', 'data-style="display:none"'):
        assert html_text.main_text(f"<body><div class=a><p>{text}</p></div><div {attributes}><p>{text}</p></div></body>") == f"{text}\n{text}", attributes
        assert html_text.main_text(f"<body><div {attributes}><article><p>{text}</p></article></div></body>") == text, attributes
    assert html_text.main_text(f'<body><div class="sidebar"><main><p>{text}</p></main></div></body>') == text
    assert html_text.main_text(f'<body><div class="widget"><p>{text}</p><p>{text}</p></div><p>Short, one.</p></body>').startswith(f"{text}\n{text}")
    for attributes in ("hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display: none"', 'class="site-footer"', 'class="sidebar"', 'class="box ad-slot"', 'id="side"', "role=search"):
        assert html_text.main_text(f"<body><article><p>{text}</p><div {attributes}><p>Not, this.</p></div></article></body>") == text, attributes


def test_html_text_keeps_lists_and_tables_without_an_article():
    ps = [f"Long words, and more of them, number {i}. " + "They go on, and on, and on without an end " * 5 + "here." for i in range(10)]
    inner = "".join(f"<p>{p}</p>" for p in ps)
    more = "<ul><li>an item of a list without marks in it</li></ul><table><tr><td>a cell</td></tr></table><figure><figcaption>a caption</figcaption></figure>"
    links = "<div><ul><li><a href=x>next page</a></li></ul></div>"
    want = [*ps, "an item of a list without marks in it", "a cell", "a caption"]
    assert html_text.main_text(f"<body><div class=content>{inner}{more}</div>{links}</body>").split("\n") == want
    got = html_text.main_text(f"<body><div class=content>{inner}{more}</div><article class=teaser><p>See this, too.</p></article>{links}</body>").split("\n")
    assert [x for x in got if x != "See this, too."] == want
    assert html_text.main_text(f"<body><article>{inner}{more}</article><div><p>Small print, only.</p></div>{links}</body>").split("\n") == want


def test_html_blank_attributes_and_odd_tags():
    text = "Some words, and more of them. They go on, and on."
    for tag in ('<div class=" ">', "<div class>", '<div id="  " role=>', "<div class='' id=\"\">", "<div a=b'c>", "<div =x / y='>'>"):
        page = f"<body>{tag}<p>{text}</p></div></body>"
        assert html_text.main_text(page) == text, tag
        for i in range(len(page)):
            html_text.main_text(page[:i])


def test_html_ratios_alone_find_the_article(spark, sf_dir):
    """Without any role, name or <article>: nearly all articles that are longer than a notice come out alike."""
    longer = wrong = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = html_text.main_text(r.html)
        if len(want) >= 800:
            plain = r.html.replace("<article>", "<div class=q7>").replace("</article>", "</div>").replace('class="ad"', "class=x")
            longer += 1
            wrong += not (html_text.main_text(r.html, roles=False) == html_text.main_text(plain, roles=False) == want)
    assert longer and wrong <= 0.05 * longer


def test_html_templates_of_odd_names():
    ps = [f"Long words, and more of them, number {i}. " + "They go on, and on, and on without an end " * 4 + "here." for i in range(8)]
    links = "<div class=k1><ul>" + "".join(f"<li><a href=/{i}>Somewhere else {i}, perhaps.</a></li>" for i in range(60)) + "</ul></div>"
    foot = "<div class=k9><span>Some firm, 2020.</span></div>"
    inner = "<h1>A head</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "<p>Short, one.</p><ul><li>an item</li></ul>"
    want = ["A head", *ps, "Short, one.", "an item"]
    for body in (f"{links}<div class=zq><div class=inner>{inner}</div></div>{foot}", f"<table><tr><td>{links}</td><td>{inner}</td></tr></table>{foot}", "".join(f"<section class=s{i}>{x}</section>" for i, x in enumerate([links, inner, foot]))):
        assert html_text.main_text(f"<html><body>{body}</body></html>").split("\n") == want
    comments = "<article class=comment><p>I think so, too. It is great, really!</p></article>" * 9
    assert html_text.main_text(f"<body><article>{inner}{comments}</article></body>").split("\n") == want
    assert html_text.main_text(f"<body><article>{inner}<section id=comments>{comments}</section></article></body>").split("\n") == want


def test_html_work_grows_with_the_page():
    import time

    took = []
    for n in (2_000, 20_000):
        pages = ["<body>" + "".join(f'<p id="p{i}" class=c{i}>Words, number {i}.</p>' for i in range(n)), "<div>" * n + "x, y." + "</div>" * n, "<b>" * n + "<p>x</i>" * n]
        began = time.perf_counter()
        found = [html_text.main_text(p) for p in pages]
        took.append(time.perf_counter() - began)
        assert found[0].count("\n") == n - 1 and found[1] == "x, y."
    assert took[1] < 5 and took[1] < 40 * took[0]


def test_html_of_no_rows(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string, url string")).collect() == []


# --- Order MinHash


def test_fingerprints_follow_the_text_alone():
    rng = random.Random(4)
    some = [prose(rng, n) for n in (0, 1, 2, 5, 50, 400)] + ["", "abc", "abcabcabc" * 30]
    together, alone = order_minhash.fingerprints(some), np.concatenate([order_minhash.fingerprints([t]) for t in some])
    assert (together == alone).all()
    assert (order_minhash.likeness(together, alone) == 1).all()


def test_fingerprints_by_brute_force():
    text, k, slots = "the cat sat on the mat and the cat sat again on the mat", 4, 8
    seen, rows = {}, []
    hashes, _, places = order_minhash.kmers(np.array([ord(c) for c in text], np.uint32), np.array([0]), np.array([len(text)]), k)
    for p, h in zip(places.tolist(), hashes):
        gram = text[p : p + k]
        seen[gram] = seen.get(gram, -1) + 1
        v = int(order_minhash.mix(np.array([h], np.uint64) + np.uint64(seen[gram]) * order_minhash.BASE)[0])
        rows.append((v % slots, v, p))
    for slot, got in enumerate(order_minhash.fingerprints([text], k=k, slots=slots)[0].tolist()):
        least = sorted(sorted((v, p) for s, v, p in rows if s == slot)[:2], key=lambda x: x[1])
        h = 0
        for j, (v, _) in enumerate(least):
            x = (h * int(order_minhash.BASE) + v + j + 1) & 0xFFFFFFFFFFFFFFFF
            h = int(order_minhash.mix(np.array([x], np.uint64))[0])
        assert got == (max(h >> 32, 1) if least else 0)


def test_likeness_falls_with_edits_and_order():
    rng = random.Random(6)
    base = [rng.choice(WORDS) + rng.choice("aeiou") * rng.randint(0, 3) for _ in range(600)]
    few, many = ([rng.choice(WORDS) if rng.random() < p else w for w in base] for p in (0.02, 0.4))
    moved = base[300:] + base[:300]
    own, a, b, c, other = order_minhash.fingerprints([" ".join(x) for x in (base, few, many, moved, [rng.choice(WORDS) for _ in base])])
    near = [order_minhash.likeness(own[None], x[None])[0] for x in (own, a, b, other)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.6 and near[3] < 0.1
    assert order_minhash.likeness(own[None], c[None])[0] < 0.9


def test_edited_texts(spark, docs, texts):
    got = {r.doc_id: r for r in order_minhash.edit_likeness(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        text, after = t or "", texts[(i - 1) % len(texts)] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, b, c = order_minhash.fingerprints([text, edited, after])
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == order_minhash.written(a[None])[0] and got[i].edited_fingerprint == order_minhash.written(b[None])[0]
        assert got[i].near_edited == order_minhash.likeness(a[None], b[None])[0] and got[i].near_next == order_minhash.likeness(a[None], c[None])[0]


def test_edited_texts_of_one_and_none(spark, docs):
    assert order_minhash.edit_likeness(docs.limit(0)).count() == 0
    one = order_minhash.edit_likeness(docs.where("doc_id = 20")).first()
    assert one.near_next == 1


# --- near-dedup


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("few", "edits", "words"), [(16, 9, 120), (0, 9, 120), (4, 14, 300), (0, 40, 900)])
def test_near_groups_by_brute_force(spark, monkeypatch, few, edits, words):
    """few: up to so many entries lists are looked at pair by pair; with 0 all go by their differences from the hub."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    rng = random.Random(8 + few + edits)
    rows, base = [], [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(words)]
    for _ in range(90):  # a large group with all degrees of likeness, chains included
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append(" ".join(w))
        base = w if rng.random() < 0.3 else base
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 30))) for _ in range(60)]
    rows += [prose(rng, rng.randint(1, 200)) for _ in range(50)] + rows[:15] + [r.upper() for r in rows[5:9]] + ODD + ["one two three", "ONE two\tthree", "one two"]
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    want = brute_groups(numbered)
    got = near_dedup.near_groups(spark.createDataFrame(numbered, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_groups_of_the_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op2_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_near_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_groups(empty).count() == 0
    blank = near_dedup.near_groups(spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in blank) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_near_groups_cases(spark):
    rng = random.Random(5)
    a, b = prose(rng, 90), prose(rng, 30_000)
    near = " ".join([*a.split()[:-2], "xx", "yy"])
    rows = [(None, a, 1, "k"), (9, near, 2, "k"), (None, a, 3, None), (4, b, 4, "k"), (5, b + " zz", 5, "k"), (4, b, 6, "k"), (4, prose(rng, 50), 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c int, kept string")
    got = near_dedup.near_groups(df).collect()
    assert len(got) == len(rows)
    # A row without doc_id links but names nothing; a repeated doc_id has a result for each of its texts.
    found = sorted(((r.doc_id or 0), len(shingles(a)) if r.n_shingles == len(shingles(a)) else r.n_shingles, r.component_id, r.kept) for r in got)
    n = len(shingles(a))
    long_ = len(shingles(b))
    assert [f for f in found if f[0] in (0, 9)] == [(0, n, 9, False), (0, n, 9, False), (9, n, 9, True)]
    assert [f for f in found if f[0] in (4, 5)] == sorted([(4, long_, 4, True)] * 2 + [(4, len(shingles(rows[6][1])), 4, True), (5, long_ + 1, 4, False)])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(300, 299), (299, 300), (7, 7)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[300] == got[299] == 299


# --- decontamination


def brute_hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for i, s in items:
            x = split(s)
            k = min(window, len(x))
            for a in range(len(x) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_by_brute_force(spark, monkeypatch, most):
    """With 0 nothing is broadcast: hashes are shuffled, texts with hits fetched again."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(14)] + [(50, None), (51, "!!"), (52, "same same same same same same same same same same same same"), (3, "a second text of item three that is long enough to count")]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[a : a + rng.randint(1, 30)]).upper(), prose(rng, rng.randint(0, 12))]
        docs.append((100 + i, "; ".join(parts)))
    docs += [docs[-1], docs[-1], (100, "same " * 40), (None, "A second text of item three -- that is long enough to count!")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == brute_hits(docs, items)


def test_winnowing_keeps_few_places_and_every_span(spark):
    rng = random.Random(1)
    w = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(4000)]
    df = decontaminate.winnowed(spark.createDataFrame([(w,), (["same"] * 30,)], "w array<string>"), 10).where("mark is not null")
    rows = df.select("w", "at", decontaminate.kept_by(10).alias("spans")).collect()
    assert len(rows) < 0.55 * (len(w) - 7) + 30
    for x in (w, ["same"] * 30):
        assert {s for r in rows if r.w == x for s in r.spans} == set(range(len(x) - 9))


def test_contamination_of_very_long_texts_without_broadcast(spark, monkeypatch):
    import time

    rng = random.Random(2)
    words = [rng.choice(WORDS) + str(i) for i in range(500)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(6000)), "x", 1) for i in range(8)], "doc_id long, text string, items string, at int")
    quotes = [(r.doc_id, " ".join(r.text.split()[2000:2040])) for r in docs.collect()]
    items = spark.createDataFrame(quotes, "item_id long, text string")
    took = []
    for most in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        began = time.perf_counter()
        got = decontaminate.contamination(docs, items).collect()
        took.append(time.perf_counter() - began)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == [(i, 6000, 40, [str(i)]) for i in range(8)]
    assert took[1] < 2 * took[0] + 2


def test_contamination_without_items_or_docs(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


# --- line dedup


def brute_lines(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((d, len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(10)
    pool = [prose(rng, 3).replace("\n", " ") for _ in range(6)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(300, rows[3][1]), (301, "a\nb\nc\na\nb\nc\na\nb\nc")]
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n_lines long, _x string")
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == brute_lines(rows)
    assert {r["_x"] for r in got} == {"x"}


def test_line_dedup_of_long_texts_and_of_nothing(spark):
    import time

    one = "\n".join(f"line {i}" for i in range(64_000))
    df = spark.createDataFrame([(1, one), (2, one + "\nlast"), (3, "x\ny\nz\n" * 3000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got[1] == (64_000, 0, one) and got[2] == (64_001, 64_000, "last") and got[3][2].count("x") == 1
    assert time.perf_counter() - began < 25
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_of_repeated_rows(spark):
    row = (1, "a\nb\nc")
    got = line_dedup.dedup_lines(spark.createDataFrame([row, row, (2, "a\nb\nc\nd"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in got if r.text is not None) == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "d", 3)]


# --- sharding


def test_shards_fit_and_split_only_if_too_large(spark):
    rng = random.Random(11)
    rows = [(i, "x" * rng.choice([0, 10, 100, 900])) for i in range(800)] + [(5000, "y" * 5000), (None, "z"), (6000, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, depth int")
    for limit in (1000, 4000, 10**7):
        out = sharding.assign(df, limit).withColumn("shard", sharding.name()).collect()
        assert len(out) == len(rows)
        sizes, many = {}, {}
        for r in out:
            sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
            many[r.shard] = many.get(r.shard, 0) + 1
        assert all(sizes[s] <= limit or many[s] == 1 for s in sizes)
        for s in sizes:  # its parent was too large
            if s != "all":
                inside = [r for r in out if r.shard.startswith(s[:-1]) or s[:-1] == ""]
                assert sum(r.n_bytes for r in inside) > limit and len(inside) > 1
    assert {s.shard for s in sharding.assign(df, 10**7).withColumn("shard", sharding.name()).collect()} == {"all"}
    assert sharding.assign(df.limit(0)).count() == 0


def test_shards_of_one_address_overflow(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 50 + [(i, "y") for i in range(20)], "doc_id long, text string")
    sizes = {}
    for r in sharding.assign(df, 1000).collect():
        sizes[r.depth, r.prefix, r.part] = sizes.get((r.depth, r.prefix, r.part), 0) + r.n_bytes
    assert max(sizes.values()) <= 1000 and sum(sizes.values()) == 5020


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write(docs, f"file://{tmp_path}/shards", 2000)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == docs.count()


# --- quality


def test_isotonic_is_the_least_squares_rising_fit():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(y) >= 0).all() and np.interp(3, x, y) == pytest.approx(2 / 3) and np.interp(1, x, y) == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_quality"](spark, sf).collect()
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, q, _ in held if q == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert np.mean([q == p for _, q, p in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == 1000


def test_quality_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 1)], "doc_id long, quality int")
    scores = [r.score for r in quality.score(docs.withColumnRenamed("source", "score"), quality.train(docs, labels)).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs, labels.where("quality = 1"))).count() == 0


# --- language


def test_folded_filters_equal_the_network():
    net = language.Network(["a", "b"])
    net.fold()
    x = np.random.default_rng(0).integers(0, language.CLASSES, (7, language.WINDOW))
    assert np.allclose(net.forward(x)[3], net.logits(x), atol=1e-4)


def test_gradients_by_differences():
    net = language.Network(["a", "b", "c"])
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 30, (4, language.WINDOW)), np.array([0, 1, 2, 1])

    def loss():
        z = net.forward(x)[3]
        return (np.log(np.exp(z).sum(1)) - z[np.arange(4), y]).mean()

    g = net.gradients(x, y)
    for k, at in (("o", (3, 1)), ("c", (2,)), ("f3", (5, 4)), ("v", (int(x[0, 9]), 2))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-5
        up = loss()
        net.p[k][at] = keep - 1e-5
        down = loss()
        net.p[k][at] = keep
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], abs=1e-5)


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_language"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 -- !!", "de"), (4, "the and of", None), (5, "x", "en"), (None, "der die das und", "de"), (7, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as lang_score")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(df, language.train(df)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in ("en", "de")
    nothing = language.identify(df, language.train(df.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# --- pipeline


def test_pipeline_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    steps = {}
    now = docs.unionByName(junk)
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.common.materialise(stage(spark, now, sf_dir), "test")
        steps[name] = now.collect()
    first = {r.doc_id: r.text for r in steps["language ID"]}
    assert set(first) <= {r.doc_id for r in docs.collect()} and len(first) >= 0.95 * docs.count()
    want = {d: t for d, _, n, t in brute_lines(list(first.items())) if not (n and not t.strip(" "))}
    second = {r.doc_id: r.text for r in steps["line dedup"]}
    assert second == want and all(r.n_chars == len(r.text) for r in steps["line dedup"])
    groups = brute_groups(list(second.items()))
    third = {r.doc_id: r.text for r in steps["near-dedup"]}
    assert third == {d: t for d, t in second.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    fourth = {r.doc_id: r.text for r in steps["decontamination"]}
    assert set(fourth) == {d for d, _, hit, _ in brute_hits(list(third.items()), items) if not hit}
    library = Tokenizer.from_file(BYTE)
    assert {r.doc_id: r.ids for r in steps["BPE"]} == {d: library.encode(t, add_special_tokens=False).ids for d, t in fourth.items()}
    assert all(r.round_trip for r in steps["BPE"])


def test_digests_of_the_tables(spark, sf_dir):
    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    library, start = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: r for r in queries.QUERIES["op3_token_files"](spark, sf_dir).collect()}
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
