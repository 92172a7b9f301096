"""Search, tokens, packing, classifier, chat, pages and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import awkward, data, frame, near_groups
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from unigram import unigram

import __spark_entry__ as entry
import corpus_pipeline
from vecbank.llm import chat, html, packing, pieces, quality, topk
from vecbank.llm.tokens import Encoder, encoder


# Search


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]  # ties
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (None, [1.0] * 24), (904, [2.0]), (905, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, vec array<double>").repartition(5)
    asked = table.filter("vec_id % 50 = 0 or vec_id in (900, 904, 905)")
    got = defaultdict(list)
    for r in topk.search(asked, table, k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(1024 * np.pad(np.array(v), (0, 24 - len(v)))) for i, v in rows + odd[5:]}
    expected = {}
    for q in [i for i in whole if i % 50 == 0 or i in (904, 905)]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:7]
        expected[q] = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert dict(got) == expected
    assert topk.search(asked.limit(0), table).collect() == [] == topk.search(asked, table.limit(0)).collect()


def test_search_refuses_what_is_not_exact(spark):
    table = spark.createDataFrame([(1, [1e30]), (2, [1e30])], "vec_id long, vec array<double>")
    with pytest.raises(ValueError, match="exact"):
        topk.search(table, table)


# SentencePiece


def test_viterbi_against_the_library():
    """The library's lattice, not its faster encoder, which misses the best segmentation of some words."""
    vocab, twin = pieces.vocabulary(), unigram(public_tokenizers.path(pieces.MODEL))
    words = sorted({w for _, t in awkward() for w in (t or "")[:3000].split()})[:1500] + ["the", "The", "Licensed", "漢字", "éß", "x" * 200, "a" * 97]
    found = pieces.segment(vocab, [pieces.MARK + w.encode() for w in words])
    for word, ids in zip(words, found, strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        theirs = twin.nbest_encode_as_ids(word, 2)[0]
        cost = lambda x: sum(0 if vocab.byte_of[i] >= 0 else vocab.scores[i] for i in x)
        unknown = lambda x: sum(vocab.byte_of[i] >= 0 for i in x)
        assert (unknown(ids), cost(ids)) == (unknown(theirs), cost(theirs)), word


def test_round_trip(spark):
    rows = awkward()
    back = pieces.decode(pieces.encode(frame(spark, rows))).collect()
    assert Counter((r[0], r[1]) for r in back) == Counter((d, (t or "").replace("▁", " ")) for d, t in rows)
    digests = pieces.digests(frame(spark, rows)).collect()
    assert len(digests) == len(rows) and all(r["round_trip"] for r in digests)
    assert pieces.digests(frame(spark, rows).limit(0)).collect() == []
    broken = spark.createDataFrame([(1, None), (2, [-1, None, 99_999_999, 300])], "doc_id long, ids array<int>")
    assert {r[0]: r[1] for r in pieces.decode(broken).collect()} == {1: "", 2: pieces.vocabulary().pieces[300].replace(pieces.MARK, b" ").decode().removeprefix(" ")}


def test_double_array_holds_exactly_its_words():
    words = [(w, i) for i, w in enumerate([b"a", b"ab", b"abc", b"b", b"bcd", bytes([255, 0]), bytes([255])])]
    vocab = pieces.Vocabulary([], np.zeros(len(words)), np.zeros(256, np.int32), np.zeros(0, np.int32), *pieces.double_array(words))
    text = np.frombuffer(b"abcd" + bytes([255, 0]) + b"\0", np.uint8)
    index, length, piece = pieces.matches(vocab, text, np.arange(6), np.full(6, 6))
    assert {(int(i), int(n), int(p)) for i, n, p in zip(index, length, piece, strict=True)} == {
        (0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 3), (1, 3, 4), (4, 2, 5), (4, 1, 6)}


# Tokens and packing


def test_remembered_units_encode_like_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["  a  b", "a  \n b", "x\t y  ", "a\n\n b c", "it's  don't 's", "  ", "a   b", "　 x   y", "\n\n  z", "a\x1c b", "12 3.4 %% $$", "a<|endoftext|>b"]
    texts = [(t or "")[:4000] for _, t in awkward()] + odd
    for own in (encoder(), Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def check_pieces(rows, texts, seq_len):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for d, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == len(ids[d])
        assert len(own) == -(-len(ids[d]) // seq_len) and all(r["length"] == seq_len for r in own[1:])
        for r in own:
            part = ids[d][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert "ids" not in r or r["ids"] == part
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= seq_len
    return len(by_sequence)


def test_pack(spark):
    texts = {d: t for d, t in awkward() if d is not None}
    rows = [r.asDict() for r in packing.pack(frame(spark, texts.items()).repartition(3), with_ids=True).collect()]
    used = check_pieces(rows, texts, 1024)
    assert used == -(-sum(r["length"] for r in rows) // 1024)  # as few as there can be
    repeated = packing.pack(frame(spark, [(None, "a"), (None, "a"), (4, None)])).collect()
    assert len(repeated) == 3 and len({r["sequence_id"] for r in repeated}) == 1
    assert packing.pack(frame(spark, texts.items()).limit(0)).collect() == []


def test_plans_hold_every_piece_and_beat_best_fit():
    rng = random.Random(5)
    for _ in range(20):
        size = rng.randint(5, 40)
        counts = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 200)))
        plan = packing.plan_bins(counts, size, nodes=500)
        used = Counter()
        for filling, times in plan:
            assert sum(k * n for k, n in filling.items()) <= size
            used.update({k: n * times for k, n in filling.items()})
        assert used == counts
        assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, size))
    assert sum(t for _, t in packing.plan_bins({6: 2, 5: 2, 4: 2, 3: 1, 2: 1}, 10)) == 4  # two sixes with fours, fives together, the rest
    assert packing.dominated((3, 2), (5,)) and not packing.dominated((5,), (3, 2))


def fewest_by_trying(counts, size):
    """The fewest sequences, by putting every piece into every room."""
    items = sorted(Counter(counts).elements(), reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*rooms, size - items[i]])

    place(0, [])
    return best


def test_search_that_ends_finds_the_fewest_sequences():
    rng = random.Random(11)
    cases = [(size, Counter(rng.randint(1, size) for _ in range(rng.randint(1, 11)))) for size in (10, 20, 37) for _ in range(60)]
    harder = [(20, Counter({10: 1, 9: 3, 8: 2, 6: 1, 5: 2, 4: 1, 3: 2})), (20, Counter({10: 3, 8: 4, 7: 1, 4: 2, 3: 1})), (30, Counter({15: 1, 12: 2, 10: 2, 7: 1, 6: 1, 4: 3, 3: 2}))]
    for size, counts in harder:
        assert sum(t for _, t in packing.best_fit(counts, size)) > sum(t for _, t in packing.plan_bins(counts, size, nodes=10**6))
    for size, counts in cases + harder:
        least = fewest_by_trying(counts, size)
        assert packing.fewest(counts, size) <= least == sum(t for _, t in packing.plan_bins(counts, size, nodes=10**6))


def test_completions_are_all_undominated_fillings():
    left = Counter({6: 1, 4: 2, 3: 2, 2: 1, 1: 1})
    found = list(packing.completions(left, 6, 10, lambda: 4, [1000]))
    assert found == [(0, (4,))]  # every other filling fits into that room
    found = list(packing.completions(Counter({6: 1, 3: 2, 2: 3}), 6, 12, lambda: 6, [1000]))
    assert found == [(0, (3, 3)), (0, (2, 2, 2))] and list(packing.completions(Counter({6: 1, 3: 1}), 6, 12, lambda: 2, [1000])) == []


# Classifier


def plain_score(network, content):
    """Every window of a text met by every filter in plain form."""
    data = np.frombuffer(content.ljust(quality.WIDTH, b"\0"), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, quality.WIDTH)
    answers = np.tensordot(network.embedding[windows].astype(np.float64), network.filters.astype(np.float64), axes=([1, 2], [0, 1])) + network.bias
    chunks = [np.maximum(answers[s : s + quality.CHUNK].max(axis=0), 0) for s in range(0, len(answers), quality.CHUNK)]
    full = chunks[:-1] if len(answers) % quality.CHUNK and len(chunks) > 1 else chunks
    features = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0), np.min(full, axis=0)])
    return 1 / (1 + np.exp(-(features @ network.out[:-1] + network.out[-1])))


def test_query_against_plain_scores_of_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    network = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in entry.queries()["op8_quality_classifier"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        wanted = plain_score(network, data(r["text"]))
        assert abs(got[r["doc_id"]]["score"] - wanted) < 1e-4
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_sample_of_the_classifier(spark):
    assert quality.within([(1, 5), (2, 9), (3, 4), (4, 1)], 10) == [1, 3, 4]
    text = bytes(range(256)) * 3
    chunks = quality.chunked(text)
    windows = [c[i : i + quality.WIDTH] for c in chunks for i in range(len(c) - quality.WIDTH + 1)]
    assert windows == [text[i : i + quality.WIDTH] for i in range(len(text) - quality.WIDTH + 1)]
    # Ids with both labels teach nothing, and of repeated rows one text is read, whatever the order.
    docs = [(d, f"{'good' if d % 2 else 'bad'} text {d} " * 30) for d in range(40)] + [(3, "zz other text")]
    marks = [(d, d % 2) for d in range(40)]
    one, other, both = (quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(m, "doc_id long, quality int"))
                        for rows, m in ((docs, marks), (docs[::-1], marks[::-1]), (docs, marks + [(d, 1 - d % 2) for d in range(40)])))
    assert all(np.array_equal(a, b) for a, b in zip(one.weights(), other.weights(), strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(both.weights(), quality.Network(0).weights(), strict=True))


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(1)
    chunks = rng.integers(0, 256, (7, quality.CHUNK + quality.WIDTH - 1)).astype(np.uint8)
    owner, labels, weight = np.array([0, 0, 0, 1, 1, 2, 2]), np.array([0, 1, 1]), np.array([1.0, 0.5, 2.0])
    whole = np.array([1, 1, 0, 1, 0, 1, 1], bool)
    network = quality.Network(3)
    found, _ = quality.gradients(network, chunks, owner, labels, weight, whole)
    close = total = 0
    for w, g in zip(network.weights(), found, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in w.shape)
            old, ends = w[at], []
            for step in (2e-3, -2e-3):
                w[at] = old + step
                ends.append(quality.gradients(network, chunks, owner, labels, weight, whole)[1])
            w[at] = old
            total += 1
            close += abs((ends[0] - ends[1]) / 4e-3 - g[at]) < 2e-2 + 0.05 * abs(g[at])
    assert close >= 0.9 * total  # maxima switch now and then


def test_scores_do_not_depend_on_blocks(monkeypatch):
    network = quality.Network(2)
    texts = [b"", b"a", b"word " * 400, bytes(range(256)) * 9]
    one = quality.scores(network, texts)
    monkeypatch.setattr(quality, "BLOCK", quality.CHUNK)
    assert np.allclose(one, quality.scores(network, texts), atol=1e-6)
    assert one.shape == (4,) and ((one >= 0) & (one <= 1)).all()


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op8_quality_classifier"](spark, sf).filter("held_out").collect()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows) and len(known) > 1000
    assert np.mean([p == q for p, q in known]) > 0.97
    assert np.mean([p == 1 for p, q in known if q == 1]) > 0.98


def test_classifier_with_awkward_rows(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(None, 1, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    network = quality.fit(docs, labels)  # nothing to learn from
    scored = quality.score(docs, network)
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"]
    got = scored.collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(docs.limit(0), network).collect() == []


# Chat


def test_rotation(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, None, None, "x"), (2, 5, "", "y"), (None, 1, "a", "z"),
            (None, 1, "b", "z"), (3, 1, "a", "same"), (3, 1, "a", "same"), (4, 300, "p", "late"), (4, 2, "q", "early")]
    table = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, block int")
    got = defaultdict(dict)
    masks = defaultdict(list)
    for r in chat.rotate(table, block_turns=2).collect():
        got[r["conv_id"], r["speaker"]][r["start"]] = r["segment"]
        if r["is_target"]:
            masks[r["conv_id"], r["speaker"]].append((r["mask_start"], r["mask_end"]))
    for key, segments in got.items():
        text = ""
        for start in sorted(segments):
            assert start == len(text)
            text += segments[start]
        for a, b in masks[key]:
            assert text[a - len("assistant\n") : a] == "assistant\n" and text[a:b].endswith(chat.END)
    assert got.keys() == {(1, "user"), (1, "assistant"), (2, "unknown"), (None, "a"), (None, "b"), (3, "a"), (4, "p"), (4, "q")}
    assert "".join(got[1, "assistant"][s] for s in sorted(got[1, "assistant"])) == (
        "<|im_start|>user name=user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user name=user\n<|im_end|>\n")
    assert len(got[3, "a"]) == 2 and "early" in got[4, "p"][0]
    assert chat.rotate(table.limit(0)).collect() == []


# Pages


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ('<div class="sidebar">x</div><p>y<br>z</p>', "y z"),
    ('<a href="x>y</a><p>t</p>', "y\n\nt"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<p>1 &lt; 2 <!-- c --> x</p", "1 < 2 x"),
    ('<body><nav>m</nav><article><header><h1>T</h1></header><p>x</p><div class="comments">c</div><ul><li>1<li>2</ul></article><footer>f</footer>', "T\n\nx\n\n1\n\n2"),
    ("<div>" * 3000 + "deep", "deep"), ("<script>if (a<b) '</p>'</script><p hidden>h</p><form>f</form><p>ok", "ok"),
    # articles that are not the page's own do not displace it
    ('<main><p>post</p></main><section class="comments"><article><p>c</p></article></section>', "post"),
    ('<main><p>post</p><article class="comment">c</article><article class="comment-body">d</article></main>', "post"),
    ('<div><p>post</p></div><article class="comment"><p>c</p></article><aside><article>t</article></aside>', "post"),
    ('<main><h1>T</h1><p>post</p><article><p>more</p></article></main><article class="teaser">t</article>', "T\n\npost\n\nmore"),
    ('<main><nav>m</nav><article class="post category-search"><p>x</p><article class="comment">c</article></article></main><div>box</div>', "x"),
    ('<main><p>post</p></main><div id="comments"><article>c</article></div><article>more</article>', "post\n\nmore"),
    # slugs are no noise
    ('<article><h2 id="search-engines">S</h2><section id="social-history"><h2>H</h2><p id="notice-of-1912">n</p></section><section id="related-work">r</section></article>',
     "S\n\nH\n\nn\n\nr"),
    ('<article><section id="search">s</section><h3 class="related">t</h3><div class="category-search">u</div><div class="comments-area">c</div><div role="search">d</div></article>',
     "s\n\nt\n\nu"),
    ('<h2 id="search">S</h2><section id="related-work">r</section><div id="comments">c</div>', "S\n\nr"),
    ('<div class="content-sidebar-wrap"><article><p>x</p></article><article><p>y</p></article></div>', "x\n\ny"),
])
def test_extraction(page, text):
    assert html.extract(html.parse(page)) == text


@pytest.mark.parametrize(("page", "text"), [
    # frames around the page are none of the things their names speak of
    ('<div class="layout has-sidebar"><h1>T</h1><p>text</p></div>', "T\n\ntext"),
    ('<body><form id="aspnetForm"><h1>T</h1><p>long text of a page</p><div class="sidebar">s</div></form></body>', "T\n\nlong text of a page"),
    ('<div role="main" class="promo-page"><p>text</p></div><div>other</div>', "text"),
    ('<div class="nav-page"><p>all of the text</p><div class="nav">menu</div></div><div>x</div>', "all of the text\n\nx"),
    # remarks and notices stay out, however long
    ('<p>short</p><div class="comments">remarks that are much longer than the text</div>', "short"),
    ('<p>short</p><div class="cookie-notice">words about cookies, many of them</div>', "short"),
    ('<p>short</p><form><p>a form with much more text in its labels</p></form><p>and more of the page than in the form</p>',
     "short\n\nand more of the page than in the form"),
])
def test_frames_and_noise(page, text):
    assert html.extract(html.parse(page)) == text


def test_templates_decide_where_markup_says_nothing(spark):
    """Neither article nor menu elements, nor telling names: boxes that come with every text of the host go, also those in
    a frame with an odd name; menus count as templates, too."""
    box = lambda i: f'<div class="x1"><ul><li>Home<li>News</ul></div><div class="has-sidebar"><div>p{i}</div><p>own text number {i}</p></div><div>imprint</div>'
    rows = [(i, f"https://a.org/{i}", box(i)) for i in range(6)] + [(10, "https://b.org/1", box(10))]
    rows += [(20 + i, f"https://c.org/{i}", f"<nav>menu</nav><p>text {i}</p><div>unlike {i}</div>") for i in range(4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(table).collect()}
    assert all(got[i] == f"p{i}\n\nown text number {i}" for i in range(6))
    assert got[10] == "Home\n\nNews\n\np10\n\nown text number 10\n\nimprint"
    assert all(got[20 + i] == f"text {i}\n\nunlike {i}" for i in range(4))
    found = {r["page_id"]: len(r["templates"]) for r in html.template_hashes(table).collect()}
    assert set(found) == {*range(6), *range(20, 24)} and found[20] == 1


def test_templates_of_a_host_go(spark):
    page = lambda i, box: f"<body><div>{box}</div><p>text {i}</p><div><p>own {i}</p></div></body>"
    rows = [(i, f"https://U@a.org:80/{i}", page(i, "box")) for i in range(4)]
    rows += [(10, "https://b.org/1", page(10, "box")), (11, None, None), (None, "https://a.org/x", page(11, "box")), (12, "https://a.org/y", "")]
    # copies of one article do not make their parts a template
    rows += [(20 + i, f"//c.org/{i}", "<article><p>same</p><ul><li>part</ul></article>") for i in range(5)]
    table = spark.createDataFrame([(*r, "own", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(table).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"text {i}\n\nown {i}" for i in range(4)) and got[10].startswith("box")
    assert got[11] == "" == got[12] and got[20] == "same\n\npart"
    assert html.extract_pages(table.limit(0)).collect() == []


def test_templates_need_a_share_of_the_texts_of_a_host(spark):
    """Never taken: parts of articles, also of near copies, rare parts of a large host, copies of one page."""
    rows = [(i, f"http://a.org/{i}", f"<article><p>own {i}</p><ul><li>part</ul><section>more</section></article>") for i in range(5)]
    rows += [(100 + i, f"http://b.org/{i}", f"<div>box</div><p>text number {i}</p>" + "<ul><li>rare</ul>" * (i < 3)) for i in range(20)]
    rows += [(200 + i, f"http://c.org/p{u}", "<div>all of the text</div><div>and more</div>") for i, u in enumerate(("", "?utm_source=x", "?page=2", "#top"))]
    rows += [(300 + i, f"http://d.org/{i}", f"<div>box</div><div>long text that several pages share</div><p>{i}</p>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i}\n\npart\n\nmore" for i in range(5))
    assert all(got[100 + i] == f"text number {i}" + "\n\nrare" * (i < 3) for i in range(20))
    assert all(got[200 + i] == "all of the text\n\nand more" for i in range(4))
    assert all(got[300 + i] == f"long text that several pages share\n\n{i}" for i in range(4))


# Pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        old, new = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in (before, kept))
        if name == "exact_dedup":
            last = {data(t): max(d for d, o in old if o == t) for _, t in old}
            assert {d for d, _ in new} == set(last.values())
        if name == "minhash_near_dedup":
            groups = near_groups(old, 5, 80)
            assert {d for d, _ in new} == {d for d, g in groups.items() if g[2]}
        if name == "suffix_array_dedup":
            assert {d for d, _ in new} == {d for d, _ in old}
            count = Counter(data(t)[i : i + 200] for _, t in old for i in range(len(data(t)) - 199))
            for (d, t) in old:
                whole = not any(count[data(t)[i : i + 200]] > 1 for i in range(len(data(t)) - 199))
                assert not whole or dict(new)[d] == t
    rows = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()]
    check_pieces(rows, dict((r["doc_id"], r["text"]) for r in kept.collect()), 1024)


def test_pipeline_with_awkward_rows(spark, sf, monkeypatch):
    docs = frame(spark, awkward()).drop("score", "d", "h", "spans")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count() > 0


def test_pipeline_keeps_one_copy_of_repeated_rows(spark, sf):
    """The row of the largest doc_id stands twice, and so does a row without id; further columns may differ."""
    rng = random.Random(6)
    kept, missing = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80)) for _ in range(2))
    docs = frame(spark, [(2**41, kept), (49, kept), (2**41, kept), (None, missing), (None, missing), (1, "short"), (1, "short"), (1, None), (1, "")])
    docs = docs.withColumn("lang", F.when(F.rand(1) < 0.5, "en").otherwise("de"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert sorted(data(r["text"]) for r in docs.collect()) == sorted([b"", b"short", kept.encode(), missing.encode()]), name
    assert {r["doc_id"] for r in docs.collect() if r["text"] in (kept, missing)} == {2**41, None}


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
