import io
import time
import tracemalloc
import wave

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, empty, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import html_extract, media, token_output


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_kept_lines_are_those_outside_a_longest_common_subsequence(a, b):
    kept = html_extract.kept_lines(a, b)
    shared = [x for i, x in enumerate(a) if i not in set(kept)]
    assert len(shared) == lcs(a, b) == lcs(shared, b)


def test_text_lines():
    html = "<!doctype html><head><title>t</title></head><body><!-- <p>no --><script>var a='</p><b>';</script><p>One <b>bold</b> &amp; two<br>three\n lines<ul><li title='a>b'>x</li><li>y&nbsp;z</li></ul>5 < 6 <style>p{}"
    assert html_extract.text_lines(html) == ["One bold & two", "three lines", "x", "y z", "5 < 6"]
    assert html_extract.text_lines(None) == html_extract.text_lines("") == html_extract.text_lines("<p></p>") == []
    assert html_extract.host_path("HTTP://u@Ex.com:80/a/b?q#f") == ("ex.com", "/a/b?q") and html_extract.host_path(None) == ("", "") and html_extract.host_path("http://h") == ("h", "/")


def brute_extract(pages):
    rows = sorted({(*html_extract.host_path(u), u, h) for u, h in pages}, key=lambda r: (r[0], r[1]))
    out = {}
    for k, (host, path, u, h) in enumerate(rows):
        own = html_extract.text_lines(h)
        fit = [(html_extract.shared_prefix(path, rows[j][1]), -j, rows[j][3]) for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][0] == host and html_extract.text_lines(rows[j][3]) != own]
        other = html_extract.text_lines(max(fit)[2]) if fit else []
        ids = {x: i for i, x in enumerate(dict.fromkeys(own + other))}
        out[u, h] = [own[i] for i in html_extract.kept_lines([ids[x] for x in own], [ids[x] for x in other])]
    return out


def test_extraction_against_brute_force_for_any_partitioning(spark):
    pages = [(i, f"http://h{i % 5 and 1 + i % 3}.org/a/{i * 7919 % 400}", f"<nav><p>Home<p>About{i % 3}</nav><article><p>{prose(i, 12)}<p>{prose(i % 4, 5)}</article><footer>foot {i % 5 and 1 + i % 3}</footer>") for i in range(150)]
    want = brute_extract([p[1:] for p in pages])
    for parts in ("1", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert len(got) == 150 and all(r.text == "\n".join(want[pages[r.page_id][1:]]) and r.n_deleted == r.n_lines - len(want[pages[r.page_id][1:]]) for r in got)


def test_runs_of_the_same_lines_and_pages_without_lines_are_passed_over(spark):
    def page(host, body):
        return f"<nav><p>Home {host}<p>About</nav><p>{body}<footer>foot {host}</footer>"

    pages = []
    for h in range(4):  # runs of 1 to 12 variants of one page, with empty and null pages before, within and behind them
        for run in range(8):
            pages += [(f"http://h{h}/r{run:02}/p?utm={v:03}", page(h, f"body {h} {run // 2 if h == 3 else run}") if (v + h) % 5 else ("", None)[v % 2]) for v in range(1 + (run * 5 + h) % 12)]
    pages += [(f"http://same/{v}", "<p>one<p>two") for v in range(9)] + [("http://tail/a", page("t", "x")), ("http://tail/b", None), *((f"http://tail/c{v}", page("t", "y")) for v in range(9))]
    rows = sorted((*html_extract.host_path(u), u, tuple(html_extract.text_lines(h))) for u, h in pages)
    want = {}
    for k, (host, path, u, own) in enumerate(rows):
        sides = [next((r for r in side if r[0] == host and r[3] and r[3] != own), None) for side in (rows[:k][::-1], rows[k + 1 :])]
        fit = [r for r in sides if r]
        other = max(fit, key=lambda r: html_extract.shared_prefix(path, r[1]))[3] if own and fit else ()
        ids = {x: i for i, x in enumerate(dict.fromkeys(own + other))}
        want[u] = [own[i] for i in html_extract.kept_lines([ids[x] for x in own], [ids[x] for x in other])]
    assert all(len(want[r[2]]) == 1 for r in rows if r[3] and r[0] != "same")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "7", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.url: r.text for r in html_extract.extract(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert got == {u: "\n".join(x) for u, x in want.items()}


def test_odd_pages(spark):
    rows = [(1, "http://a/x", "<p>nav<p>one"), (2, "http://a/y", "<p>nav<p>two"), (2, "http://a/y", "<p>nav<p>two"), (3, None, None), (4, "", ""), (None, "http://b/", "<p>solo"), (5, "not a url", "<p>" + "long " * 50_000), (6, "http://c/1", "<p>same"), (7, "http://c/2", "<p>same")]
    df = spark.createDataFrame([(*r, "h", "p", "l") for r in rows], "page_id long, url string, html string, host string, path string, lines string")
    got = sorted((r.page_id or 0, r.text) for r in html_extract.extract(df).collect())
    assert got == [(0, "solo"), (1, "one"), (2, "two"), (2, "two"), (3, ""), (4, ""), (5, ("long " * 50_000).strip()), (6, "same"), (7, "same")]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_fingerprints_against_plain_loops():
    rng = np.random.default_rng(5)
    x = media.melody(rng.normal(0, 0.12, 40)) * 0.5 + rng.normal(0, 0.01, 6400)
    wav = media.write_wav(x)
    status, rate, n, times, codes = media.fingerprint(wav, 4)
    rate_, channels, width, raw = media.read_wav(wav)
    y = media.samples(raw, channels, width)
    many = len(y)
    while (len(y) - media.FRAME) % media.HOP:
        y = np.append(y, 0.0)
    frames = range(0, len(y) - media.FRAME + 1, media.HOP)
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / media.FRAME) for k in range(media.FRAME)]
    level = np.array([20 * np.log10(np.abs(np.fft.rfft(y[f : f + media.FRAME] * hann)) + 1e-9) for f in frames])
    top = []
    for t in range(level.shape[0]):
        for b in range(level.shape[1]):
            if level[t, b] >= level.max() - media.RANGE_DB and level[t, b] >= level[max(0, t - 2) : t + 3, max(0, b - 6) : b + 7].max():
                top.append((t, b))
    want = []
    for t, b in top:
        for t2, b2 in [q for q in top if q[0] > t][:4]:
            if t2 - t <= media.REACH:
                want.append((t, (b << 9 | b2) << 5 | t2 - t))
    assert (status, rate, n) == ("ok", 8000, 6400) and sorted(want) == list(zip(times.tolist(), codes.tolist(), strict=True))


def test_an_excerpt_has_the_codes_of_its_recording():
    x = media.melody(np.random.default_rng(6).normal(0, 0.12, 200))
    _, _, _, t, c = media.fingerprint(media.write_wav(x), 5)
    _, _, _, t2, c2 = media.fingerprint(media.write_wav(x[40 * media.HOP : 90 * media.HOP] * 0.7), 5)
    whole = set(zip(t.tolist(), c.tolist(), strict=True))
    assert sum((a + 40, b) in whole for a, b in zip(t2.tolist(), c2.tolist(), strict=True)) > 0.8 * len(t2)


def wav(width, channels, n, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes((i * 37) % 251 for i in range(n * width * channels)))
    return out.getvalue()


def test_odd_media(spark):
    rows = [(1, None), (2, b""), (3, b"RIFFjunk"), (4, wav(2, 1, 0)), (5, wav(1, 2, 900)), (6, wav(3, 1, 900)), (7, wav(4, 2, 900)), (8, wav(2, 1, 100)), (None, wav(2, 1, 2000)), (8, wav(2, 1, 100)), (9, wav(2, 1, 3000)[:-7]), (10, media.write_wav(np.zeros(4000))), (11, wav(2, 1, 500_000))]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, wav binary, status string, times int")
    got = media.fingerprints(df, "vec_id", "wav").collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) and by[1].status == "null" and by[2].status == by[3].status == "invalid" and by[1].times is None
    assert by[4].status == "ok" and by[4].times == [] == by[10].codes and by[5].n_samples == 900 and len(by[None].times) == len(by[None].codes) > 0
    assert media.samples(media.read_wav(wav(3, 1, 4))[3], 1, 3).shape == (4,)
    vectors = spark.createDataFrame([(1, [0.1, None, -0.2]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.status for r in media.fingerprints(media.sound(vectors, "vec_id", "embedding"), "vec_id", "wav").collect()} == {1: "ok", 2: "null", 3: "ok"}
    assert media.fingerprints(df.limit(0), "vec_id", "wav").count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("a b\n\té'sx.,1 \x1c\xa0 日", max_size=40) | st.text("ab \n", max_size=12) | st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_cached_units_give_the_tokenizers_ids(text):
    coder = token_output.coder_of(token_output.VOCABULARY)
    ids = np.frombuffer(coder.encode(text), "<i4").tolist()
    assert ids == coder.encoding.encode_ordinary(text) and coder.encoding.decode(ids) == text


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_written_layout_and_round_trip(spark, tmp_path, encoding):
    docs = spark.createDataFrame([(i, prose(i, 200), "en", f"s{i % 3}") for i in range(600)], "doc_id long, text string, lang string, source string").repartition(2)
    path = f"file://{tmp_path}/t"
    token_output.write_tokens(docs, path, encoding=encoding, row_group_bytes=200_000, page_rows=50)
    coder = token_output.coder_of(token_output.VOCABULARY)
    back = {r.doc_id: coder.encoding.decode(r.token_ids) for r in token_output.read_tokens(spark, path).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    files = list((tmp_path / "t").glob("*.parquet"))
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 1
        column = next(c for k in range(meta.num_columns) if (c := meta.row_group(0).column(k)).path_in_schema == "token_ids.list.element")
        assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta") and column.has_offset_index and meta.row_group(0).column(0).has_column_index
        assert column.has_dictionary_page == (encoding == "dictionary")
    some = token_output.read_tokens(spark, path, (100, 119), ["doc_id", "n_tokens"])
    assert some.count() == 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan.split("ReadSchema")[-1] and "GreaterThanOrEqual(doc_id,100)" in plan


def test_odd_tokens(spark):
    docs = table(spark)
    got = token_output.token_table(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and by[3].token_ids is None and by[3].n_tokens is None and by[4].token_ids == [] and all(r.n_tokens == len(r.token_ids) for r in got if r.token_ids is not None)
    assert token_output.token_table(empty(spark)).count() == 0
    assert "token_ids" not in SCHEMA
    with pytest.raises(ValueError):
        token_output.write_tokens(docs, "x", encoding="none")


def test_blocks_give_the_peaks_of_the_whole():
    rng = np.random.default_rng(8)
    raw = (rng.normal(0, 3000, 9 * media.HOP + 77)).astype("<i2").tobytes()
    whole = media.peaks(raw, 1, 2)
    assert len(whole[0])
    for block in (1, 2, 3, 7):
        assert all((a == b).all() for a, b in zip(media.peaks(raw, 1, 2, block), whole, strict=True))


def test_wav_headers_of_any_rate_and_width(spark):
    good = media.write_wav(np.sin(np.arange(3000) / 5))
    wide = b"RIFF" + (36 + 6000).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (48000).to_bytes(4, "little") + (6).to_bytes(2, "little")
    wide += (48).to_bytes(2, "little") + b"data" + (6000).to_bytes(4, "little") + bytes(range(250)) * 24
    fast = good[:24] + (2**32 - 1).to_bytes(4, "little") + good[28:]
    df = spark.createDataFrame([("1", wide), ("2", fast), ("x", good)], "vec_id string, wav binary")
    got = {r.vec_id: (r.status, r.sample_rate, r.n_samples) for r in media.fingerprints(df, "vec_id", "wav").collect()}
    assert got == {1: ("ok", 8000, 1000), 2: ("ok", 2**32 - 1, 3000), None: ("ok", 8000, 3000)}
    x = media.samples(b"\0\0" + (2**30).to_bytes(4, "little"), 1, 6)
    assert x.tolist() == [0.5]


def test_pages_that_never_close_take_linear_time():
    for page in ("<script" * 40_000, "<a " * 60_000, "<!--" * 60_000, "</script" * 40_000, "<style>" + "</style " * 40_000, '<a ">" ' * 40_000, "<" * 200_000, "<div>" * 100_000 + "x"):
        began = time.process_time()
        html_extract.text_lines(page)
        assert time.process_time() - began < 5
    assert html_extract.text_lines("a<!-- b --> c<SCRIPT x>d</Script >e<style>f") == ["a c e"] and html_extract.text_lines("a <script b") == ["a <script b"]


def test_rare_lines_of_long_pages_are_aligned_alike(monkeypatch):
    rng = np.random.default_rng(10)
    for _ in range(30):
        a, b = (np.where(rng.random(60) < 0.5, 0, rng.integers(0, 40, 60)).tolist() for _ in range(2))
        want = html_extract.kept_lines(a, b)
        assert len(a) - len(want) == lcs(a, b)
        monkeypatch.setattr(html_extract, "SHORT", 0)
        assert html_extract.kept_lines(a, b) == want
        monkeypatch.undo()


def test_many_lines_take_little_memory():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 3000, 6000).tolist(), rng.integers(0, 3000, 6000).tolist()
    tracemalloc.start()
    kept = html_extract.kept_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500_000 and 0 < len(kept) < 6000


def test_token_units_of_any_white_space_and_symbols():
    rng = np.random.default_rng(0)
    parts = [" ", "\n", "  ", "\t", "a", "b'll", "é", " ", "　", "\x1c", "\x85", "don't", "12", "!!", "\r\n", "ü.", "中", "…."]
    texts = ["", " ", "\n", "a ", " a", "a\n", "\na", "a\n b", "x" * 5000 + ".y", *("".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(1000))]
    coder = token_output.Coder(token_output.VOCABULARY, most=50)
    flat, size = coder.encode_all(pa.array([*texts, None]))
    ends = np.r_[0, np.cumsum(size)]
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [coder.encoding.encode_ordinary(t) for t in texts] + [[]]
