"""Each operator against a plain computation on the smallest tables."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from rolecall.llm import (bpe_codec, decontamination, html_extraction, language_id, line_dedup, lm_scoring,
                          quality_rules, simhash_dedup, substring_dedup, url_filters)

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- SimHash

def fingerprint(text, size=3):
    found = WORD.findall(lowered(text))
    if not found:
        return 0
    parts = [" ".join(found[i:i + size]) for i in range(len(found) - size + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, max_bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def prints(docs):
    return {i: fingerprint(r.text) for i, r in docs.items()}


def test_simhash_classes(spark, prints):
    rows = simhash_dedup.op1_simhash_dedup(spark, FOLDER).collect()
    wanted = classes(prints, 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{p:016x}", wanted[i]) for i, p in prints.items()}


@pytest.mark.parametrize("max_bits, node", [(0, 1 << 16), (2, 24), (4, 1 << 16)])
def test_trie_walk_over_split_nodes(spark, rows, max_bits, node):
    random = np.random.default_rng(3)
    base = random.integers(0, 2**63, 12, dtype=np.uint64)
    keys = {int(b) for b in base}
    for b in base:  # dense balls around few centres, so that nodes are large
        for _ in range(25):
            flips = random.choice(64, random.integers(1, 5), replace=False)
            keys.add(int(b) ^ sum(1 << int(f) for f in flips))
    keys = sorted(keys)
    frame = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "fingerprint long")
    found = simhash_dedup.fingerprint_pairs(frame, max_bits, node).collect()
    mask = (1 << 64) - 1
    pairs = [(r.a & mask, r.b & mask) for r in found]
    wanted = {(a, b) for n, a in enumerate(keys) for b in keys[n + 1:] if (a ^ b).bit_count() <= max_bits}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
    wanted_classes = classes({i: k for i, k in enumerate(keys)}, max_bits)
    links = simhash_dedup._walked(frame, max_bits, False, node)
    roots = {r.node & mask: r.root & mask for r in simhash_dedup.components(links).collect()}
    by_root = collections.defaultdict(set)
    for k in keys:
        by_root[roots.get(k, k)].add(k)
    by_class = collections.defaultdict(set)
    for i, c in wanted_classes.items():
        by_class[c].add(keys[i])
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_class.values()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95)], "a long, b long")
    found = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert found.keys() == {*range(61), 90, 95, 100}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in (90, 95, 100)}) == 1
    assert found[0] in range(61) and found[90] in (90, 95, 100)


# ---- URL filters

def test_url_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    extra = {-1: None, -2: "no scheme", -3: "http://EXAMPLE.com/en/x?y#z", -4: "x://a://b/c", -5: "http://net/es/",
             -6: "http://www.example.com/en/1", -7: "http://notexample.com/en/", -8: "http://a.www.example.com/en/q",
             -9: "http://www.example.com", -10: "//x.com/", -11: "http://a.net/fr", -12: "http://É.com/en/"}
    frame = spark.createDataFrame([(i, u) for i, u in {**urls, **extra}.items()], "page_id long, url string")
    out = url_filters.url_filter(frame, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    assert len(out) == len(urls) + len(extra)
    for r in out:
        url, host, path, best = {**urls, **extra}[r.page_id], "", "", None
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
            host = lowered(host)
        for verdict, rule_host, start in url_filters.RULES:
            if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(start):
                if best is None or len(rule_host + start) > len(best[1]):
                    best = (verdict, rule_host + start)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        if best:
            assert r.verdict == best[0]


def test_url_rules_are_learned(spark):
    pages = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}-site{i % 7}.org/en/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 400, 2)]
    out = url_filters.url_filter(spark.createDataFrame(pages, "page_id long, url string"),
                                 spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    # every address has the word, also those without a label
    assert all(r.verdict == ("block" if r.page_id % 4 == 0 else "allow") for r in out)
    assert all(r.rule is None and (r.mined_rule is not None) == (r.verdict == "block") for r in out)


# ---- Decontamination

def test_decontamination_finds_planted_passages(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    exact = {(i, k) for i, r in docs.items() for k, t in items.items() if " ".join(t.split()) in " ".join(r.text.split())}
    found = {(r.doc_id, r.item_id) for r in decontamination.op3_decontamination(spark, FOLDER).collect()}
    assert exact and exact <= found
    for i, k in found - exact:  # anything else shares most of an item or of a passage, in order
        a, b = (re.findall(r"\w+", x.lower()) for x in (items[k], docs[i].text))
        grams = set(zip(b, b[1:], b[2:]))
        assert sum(g in grams for g in zip(a, a[1:], a[2:])) >= 5


def test_decontamination_of_paraphrases(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [r.text for r in docs.values() if len(r.text) > 1500][:20]
    random = np.random.default_rng(5)
    planted = []
    for n, (item, text) in enumerate(items):
        found = text.split()
        for at in range(3, len(found), 6):  # one word in six is another
            found[at] = f"qx{random.integers(1000)}"
        about = clean[n % len(clean)].split()
        planted.append((n, " ".join(about[:40] + [w.upper() for w in found] + about[40:90])))
    documents = planted + [(10_000 + n, " ".join(t.split()[100:])) for n, t in enumerate(clean)]
    out = decontamination.benchmark_matches(
        spark.createDataFrame(documents, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()
    hit = {(r.doc_id, r.item_id) for r in out}
    wanted = {(n, item) for n, (item, _) in enumerate(items)}
    assert len(hit & wanted) >= 0.9 * len(wanted)


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    random = np.random.default_rng(1)
    for _ in range(50):
        a, b = (random.integers(0, 5, random.integers(1, 70)) for _ in range(2))
        assert decontamination._lcs(a, b) == plain(a.tolist(), b.tolist())


# ---- Language model

def test_lm_scores(spark, docs):
    tokens = {i: [*WORD.findall(lowered(r.text)), " "] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = collections.Counter(t for i, x in tokens.items() if not held[i] for t in x)
    total, distinct = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in x) for i, x in tokens.items()}
    out = {r.doc_id: r for r in lm_scoring.op5_lm_scoring(spark, FOLDER).collect()}
    assert out.keys() == docs.keys()
    for i, r in out.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[i], len(tokens[i]), sum(t in counts for t in tokens[i]), total)
        assert r.base_score == pytest.approx(base[i], rel=1e-9)
        assert r.score < 0
    # the two-word model says more about held-out texts than the one-word one
    assert sum(out[i].score for i in out if held[i]) > sum(base[i] for i in out if held[i])


def test_filter_gives_size_classes():
    random = np.random.default_rng(2)
    grams = np.unique(random.integers(0, 2**48, 5000, dtype=np.uint64))
    counts = random.integers(1, 200, len(grams))
    bucket = lm_scoring._bucket(grams, 2, 4)
    import pandas as pd
    rows = []
    for b in range(4):
        part = lm_scoring._segment(1 << 20)(pd.DataFrame(
            {"n": [2], "bucket": [b], "grams": [lm_scoring._pack(grams[bucket == b], counts[bucket == b])]}))
        rows.append(part.iloc[0].to_dict())
    found = lm_scoring.Filter(rows, 4).counts(grams, 2)
    level = np.floor(np.log2(counts))
    assert (found >= 1.5 * 2**level - 0.5).all()  # never below its class
    assert np.mean(found == 1.5 * 2**level - 0.5) > 0.97


def test_score_does_not_depend_on_the_largest_filter_sent(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sent, asked = ({r.doc_id: r for r in lm_scoring.score_texts(frame, filter_bytes=n).collect()} for n in (1 << 26, 1 << 10))
    assert sent.keys() == asked.keys()
    for i, r in sent.items():
        assert asked[i][:5] == r[:5]
        assert asked[i].base_score == pytest.approx(r.base_score, rel=1e-9)
        assert asked[i].score == pytest.approx(r.score, rel=1e-9)


# ---- BPE

@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    return bpe_codec.Task(bpe_codec.Codec(
        bpe_codec.read_ranks(public_tokenizers.path(bpe_codec.VOCABULARY)), public_tokenizers.PATTERN))


def test_bpe_agrees_with_the_library(spark, docs, codec):
    import public_tokenizers
    import tiktoken
    library = tiktoken.Encoding("own", pat_str=codec.codec.pattern, mergeable_ranks=codec.codec.ranks, special_tokens={})
    assert public_tokenizers.PATTERN == codec.codec.pattern
    for r in bpe_codec.op6_bpe_codec(spark, FOLDER).collect():
        ids = library.encode_ordinary(docs[r.doc_id].text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest()
    pool = [chr(i) for i in range(0x250)] + list("\u1680\u2003\u2028\u200b\u3000\U0001f600中\u0301\ufeff٠Ⅰ")
    random = np.random.default_rng(4)
    for _ in range(2000):
        text = "".join(random.choice(pool if random.random() < 0.5 else list(" \n\t'sabcthe123.,!"))
                       for _ in range(random.integers(0, 25)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    for text in ("a" * 5000, " " * 3000, "ab" * 4000 + " x" * 10):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_of_a_long_text_and_a_full_cache(codec, monkeypatch):
    text = " ".join(f"wörd{i} x{i * 7}" for i in range(4000))
    whole = codec.encode(text)
    monkeypatch.setattr(bpe_codec, "LISTED", 100)
    monkeypatch.setattr(bpe_codec, "GROUP", 7)
    monkeypatch.setattr(bpe_codec, "CACHE", 50)
    codec.recent, codec.older = {}, {}
    assert codec.encode(text) == whole and codec.decode(whole).decode() == text


def test_perfect_hash(codec):
    table = codec.codec.whole
    assert sorted(k for k in table.keys) == sorted(codec.codec.ranks)  # one slot a key, none left over
    assert all(table.get(k) == rank for k, rank in codec.codec.ranks.items())
    assert table.get(b"no token of any vocabulary") is None
    assert bpe_codec.PerfectHash({}).get(b"a") is None


# ---- HTML

def test_html_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in html_extraction.op7_html_extraction(spark, FOLDER).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)).split() for b in re.split("</?(?:h1|p|br)>", article)]
        assert r.text == " ".join(" ".join(b) for b in blocks if b) and r.n_chars == len(r.text)


HARD = """<html><body class="with-sidebar"><header class="top"><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><div id="wrap"><div class="post-content"><h2>Title &amp; more</h2>
<p>First para <a href=1>link</a> soft<b>ware</b>.<p>Second&nbsp;para <span class="ad">Buy!</span> end<br>line</p>
<form><input><label>Mail</label></form><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><!-- <p>no</p> -->
<div class="comments"><p>Nice post! A very long comment by a reader, longer than the rest of the page is.</p></div>
<script>var a="</p>"</script></div><aside>side text</aside></div><footer>f</footer></body>"""


def test_html_of_harder_pages():
    def text(source, winner=None):
        page = html_extraction.Page(source)
        page.settle()
        return page.text(winner)[0]

    assert text(HARD) == "Title & more First para link software. Second para end line one two c1 c2"
    assert text("") == text("<") .replace("<", "") == text("<p") == ""
    assert text("plain text") == "plain text"
    assert text("</p></div>a<p>b") == "a b"
    assert len(text("<div>" * 50_000 + "x<p>y</p>" * 500)) == 1999
    assert text("<article><p>" + "\"'" * 30_000 + "</p></article>") == "\"'" * 30_000


def test_html_pages_follow_their_host(spark):
    good = "<body><div class=a><p>{0} text of the article goes here and on</p></div><div class=b><p>short</p></div></body>"
    odd = "<body><div class=a><p>the article is {0} words this time</p></div><div class=b><p>but the box below it is long now, much more</p></div></body>"
    pages = [(i, f"http://h.org/{i}", good.format(i)) for i in range(5)] + [(9, "http://h.org/9", odd.format(9))]
    out = {r.page_id: r.text for r in html_extraction.extract_texts(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[9] == "the article is 9 words this time"


# ---- Substrings

def substring_wanted(texts, size=20):
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        found = WORD.findall(text or "")
        cut = [False] * len(found)
        for a in range(len(found) - size + 1):
            window = tuple(found[a:a + size])
            if window in seen:
                cut[a:a + size] = [True] * size
            seen.add(window)
        out[i] = (len(found), sum(cut), " ".join(w for w, c in zip(found, cut) if not c))
    return out


def test_substrings(spark, docs):
    wanted = substring_wanted({i: r.text for i, r in docs.items()})
    out = substring_dedup.op8_substring_dedup(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == {
        i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in wanted.items()}


def test_substrings_over_many_small_blocks(spark, monkeypatch):
    random = np.random.default_rng(6)
    passages = [[f"w{random.integers(60)}" for _ in range(30)] for _ in range(5)]
    texts = {}
    for i in range(120):
        parts = [f"w{random.integers(60)}" for _ in range(random.integers(0, 40))]
        for _ in range(random.integers(0, 3)):
            p = passages[random.integers(5)]
            a = random.integers(0, 8)
            parts += p[a:random.integers(a + 15, 31)] + [f"v{random.integers(9)}"]
        texts[i * 10**16 - 5 * 10**17] = " ".join(parts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    out = substring_dedup.substring_dedup(frame).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == substring_wanted(texts)
    for r in out:  # the spans are what is cut
        assert sum(r.span_lengths or []) >= r.n_removed


# ---- Languages, quality, lines, pipeline

def test_languages_of_held_out_texts(spark, docs):
    out = language_id.op9_language_id(spark, FOLDER).collect()
    assert len(out) == len(docs)
    assert np.mean([r.text_language == docs[r.doc_id].lang for r in out]) > 0.97  # the text alone
    assert np.mean([r.language == docs[r.doc_id].lang and r.kept for r in out]) > 0.98
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert language_id.page_evidence(pages).where("declared IS NULL OR host IS NULL").count() == 0


def test_quality_marks_junk(spark):
    out = {r.doc_id: r for r in quality_rules.op10_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [out[r.doc_id].kept for r in labels if r.quality == 1 and r.doc_id in out and not out[r.doc_id].base_failed]
    bad = [out[r.doc_id].kept for r in labels if r.quality == 0 and r.doc_id in out]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25


def lines_wanted(texts, min_lines, min_words):
    seen, runs, out = set(), set(), {}
    for i, text in sorted(texts.items()):
        lines = text.split("\n")
        full = [(n, x.strip(" \t\x0b\f\r")) for n, x in enumerate(lines) if WORD.search(x)]
        cut = set()
        for k, (n, line) in enumerate(full):
            if line in seen and len(WORD.findall(line)) >= min_words:
                cut.add(n)
            seen.add(line)
        for k in range(len(full) - min_lines + 1):
            run = tuple(x for _, x in full[k:k + min_lines])
            if run in runs:
                cut.update(n for n, _ in full[k:k + min_lines])
            runs.add(run)
        out[i] = ("\n".join(x for n, x in enumerate(lines) if n not in cut), len(full), len(cut))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 7])
def test_line_runs(spark, min_lines):
    random = np.random.default_rng(min_lines)
    pool = ["a", "b c", " b c\t", "", "  ", "one two three four five six", "d", "e"]
    texts = {i: "\n".join(random.choice(pool, random.integers(0, 30))) for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = line_dedup.line_dedup(frame, min_lines, 6).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out} == lines_wanted(texts, min_lines, 6)


def test_pipeline_stages(spark, docs, prints):
    from rolecall.llm import words
    names = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in frame.collect()}
        frame = words.stored(stage(spark, frame, FOLDER), "test")
        after = {r.doc_id: r for r in frame.collect()}
        assert frame.columns == names and after.keys() <= before.keys()
        seen.append(name)
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "line_dedup":
            wanted = lines_wanted({i: r.text for i, r in before.items()}, line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
            assert {i: (r.text, r.n_chars) for i, r in after.items()} == {
                i: (t, len(t)) for i, (t, n, k) in wanted.items() if not n or k < n}
        if name == "simhash_dedup":
            first = classes({i: fingerprint(r.text) for i, r in before.items()}, 2)
            assert after.keys() == {i for i in before if first[i] == i}
        if name == "decontamination":
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            held = {i for i, r in before.items() if any(t in " ".join(r.text.split()) for t in items)}
            assert held and not held & after.keys() and len(after) >= len(before) - len(held) - 2
    last = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {
        i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in after.items()}
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in last}
    assert [n for n, _ in corpus_pipeline.STAGES] == [*seen, "bpe_codec"]
