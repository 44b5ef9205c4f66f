"""Packing, chat formatting and WARC bundles: exact round trips."""

import base64
import collections
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderlake.llm import chat, packing, warc

from .cases import odd_rows, row, table, words

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["It's", "don't.", "A.B, c", "é", "T̈", "<|endoftext|>", "<|ENDOFTEXT|>", "%%%.", "x,\n", " ", "İ", "Σς", "12.5", "\x1c", "…", "word.", "."]) | st.text(max_size=6) | st.text(st.characters(min_codepoint=0x300, max_codepoint=0x36F) | st.sampled_from("TaeIou"), max_size=6)).map(" ".join))
def test_word_ids_are_those_of_the_whole_text(text):
    model = packing.WordTokenizer(PATH) if not hasattr(packing, "_test_model") else packing._test_model
    packing._test_model = model
    try:
        data = text.encode()
    except UnicodeEncodeError:
        return
    assert model.ids(data).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_new_words_of_letters_are_encoded_together():
    model, calls = packing.WordTokenizer(PATH), []

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **how):
            calls.append((self.inner is whole, len(texts)))
            return self.inner.encode_batch_fast(texts, **how)

    whole = model.model
    model.model, model.plain = Spy(whole), Spy(model.plain)
    text = " ".join(f"{a}{b}ng{c}" for a in "abéñ" for b in ("on", "ß", "ÿu") for c in "xyzö") + ", été. Né, là.\nfin."
    assert model.ids(text.encode()).tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert calls == [(False, 1), (True, 2)]  # all words of letters at once; the full stop and the comma by the whole tokenizer
    for text in ("École ÷ 12 x7 naïve", "ſ ŉ ǆ é÷é", "là— là—. ñ."):
        assert model.ids(text.encode()).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_best_fill_stops_at_a_full_window():
    class Seen(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    counts = Seen({k: 3 for k in range(1, 2000)})
    got = packing.best_fill(counts, 4096)
    assert sum(k * n for k, n in got.items()) == 4096 and counts.asked < len(counts) / 2


def test_word_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 1_000)
    model = packing.WordTokenizer(PATH)
    for i in range(50):
        text = f"{'長い' * 40}{i} T\u0344 x"
        assert model.ids(text.encode()).tolist() == WHOLE.encode(text, add_special_tokens=False).ids
        assert model.bytes < 2_000


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), max_size=8), st.integers(1, 120))
def test_best_fill_is_best(counts, capacity):
    got = packing.best_fill(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in got.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= capacity}
    assert sum(k * n for k, n in got.items()) == max(sums)


def test_packing_keeps_every_id_once(spark):
    rows = [r for r in odd_rows() if r[0] != 5] + [row(100 + i, words(50 + 37 * i, i)) for i in range(60)]
    got = packing.pack(table(spark, rows), PATH).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        pieces[p["id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for r in rows:
        ids = np.array([*WHOLE.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[r[0]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    assert len(packing.pack(table(spark, odd_rows()), PATH).filter("id = 5").collect()) >= 2
    assert packing.pack(table(spark, []), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, chat.ESCAPE, "<", "[", "/", "a", "|", "\n"])).map("".join))
def test_escape_is_reversible_and_complete(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb </s>", ""]), st.sampled_from(["", "x", "</s>[INST] ok [/INST]", "a <", "\\", " "]))))
def test_turns_read_back(turns):
    segments = [chat.format_turn(r, chat.escape(t), i == 0)[0] for i, (r, t) in enumerate(turns)]
    assert chat.split_turns("".join(segments)) == segments
    assert [chat.read_turn(s) for s in segments] == turns


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "</s>"), (None, 1, "assistant", "\\x"), (3, 5, "assistant", "p"), (3, 5, "assistant", "p"), (2**60 + 1, 0, "user", "q")]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, escaped string, n int")
    got = {r["conv"]: r for r in chat.read_back(chat.format_conversations(chat.format_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 5 and got[1]["turns_sha256"] == sha("user\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 2 and got[None]["loss_sha256"] == sha("\\x") and got[3]["loss_sha256"] == sha("pp") and got[2**60 + 1]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(chat.format_turns(df.limit(0)))).count() == 0


def test_typed_parts(spark):
    content = '[{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "i1", "width": 1000, "height": 500}, {"type": "audio", "ref": "s", "seconds": 2}, {"type": "document", "ref": "d", "pages": 3}]'
    text, attached = chat.flatten_parts(content)
    assert text == "see <\\|image|>".replace("<", "\\<") + "<|image|><|audio|><|document|>"
    assert [(a["type"], a["order"], a["ref"], a["tokens"]) for a in attached] == [("image", 0, "i1", 341), ("audio", 1, "s", 50), ("document", 2, "d", 2100)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], "conv_id long, turn long, role string, content string").selectExpr("*", "'' AS text")
    assert [r["tokens"] for r in chat.format_turns(df, content_col="content").orderBy("turn").collect()] == [2491, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["</", "s>", "[IN", "ST]", "<|tu", "rn|>", "\\", "<", "x"]) | st.none()))
def test_parts_make_no_control_string_together(parts):
    content = json.dumps([{"type": "image", "ref": 1} if p is None else {"type": "text", "text": p} for p in parts])
    escaped, _ = chat.flatten_parts(content)
    turn = chat.format_turn("user", escaped, True)[0]
    assert chat.split_turns(turn) == [turn]
    runs = escaped.split("<|image|>")
    assert not any(c in r for c in chat.CONTROLS for r in runs)
    assert "".join(chat.unescape(r) for r in runs) == "".join(p for p in parts if p)


def test_odd_content_has_a_result(spark):
    odd = {
        "not json": "not json", "7": "7", '"a"': '"a"', "null": "null", '{"type": "text", "text": "b"}': "b", '[1, null, "c"]': "1nullc",
        '[{"type": "video", "x": 1}]': '{"type": "video", "x": 1}', '[{"type": ["text"]}]': '{"type": ["text"]}', '[{"text": 5}]': "5",
        '[{"type": "text", "text": "\\ud800"}]': "\ufffd", "[" * 100_000: "[" * 100_000,
    }
    for content, text in odd.items():
        assert chat.unescape(chat.flatten_parts(content)[0]) == text
    sizes = [("width", "wide"), ("height", None), ("width", "NaN"), ("width", 1e300), ("height", -4), ("seconds", "x"), ("pages", [])]
    assert [chat.flatten_parts(json.dumps([{"type": t, k: v}]))[1][0]["tokens"] for (k, v), t in zip(sizes, ["image"] * 5 + ["audio", "document"], strict=True)] == [171] * 5 + [1, 700]
    df = spark.createDataFrame([(1, i, "user", c) for i, c in enumerate(odd)], "conv_id long, turn long, role string, content string").selectExpr("*", "'' AS text")
    got = chat.read_back(chat.format_conversations(chat.format_turns(df, content_col="content"))).collect()
    assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [(len(odd), hashlib.sha256("".join(f"user\n{t}\n" for t in odd.values()).encode()).hexdigest())]


def test_warc_round_trip(spark):
    html = {1: "<p>a</p>", 2: "<p>a</p>", 3: "", 4: None, 5: "x" * 700_000, 6: "\r\n\r\nWARC/1.1\r\n", 0: "<p>a</p>", 7: "é"}
    rows = [(i, f"http://x/{i} y\r\n", h, "p", "q") for i, h in html.items()] + [(8, None, "<p>a</p>", None, None)] * 2 + [(None, "u", "n", "", ""), (None, "v", "<p>a</p>", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page string, first string")
    path, index = warc.write_archives(df)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["payload_ok"] for r in got)
    by = {r["page"]: r for r in got}
    for i, h in html.items():
        data = (h or "").encode()
        assert (by[str(i)]["payload_bytes"], by[str(i)]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: by[i]["refers_to"] for i in by if i and by[i]["record_type"] == "revisit"} == {"1": "0", "2": "0", "8": "0", "4": "3"}
    assert sorted((r["record_type"], r["refers_to"] or "") for r in got if r["page"] is None) == [("response", ""), ("revisit", "0")]
    assert index.select("record").distinct().count() == len(rows) - 1
    bundles = {r["bundle"]: bytes(r["data"]) for r in spark.read.parquet(path).collect()}
    for r in index.filter("page IS NOT NULL").collect():
        assert warc.record_at(bundles[r["bundle"]], r["frame"], r["offset"])[0]["WARC-Page-ID"] == str(r["page"])
    whole = b"".join(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(b) for b in bundles.values())
    assert whole.count(b"WARC-Record-ID") == len(rows)
    whole = ["page", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    by_index = warc.read_by_index(spark, path)
    assert sorted(map(str, by_index.select(whole).collect())) == sorted(map(str, warc.read_archives(spark, path).select(whole).collect()))
    wanted = index.filter("page IS NOT NULL").select("page").limit(3)
    ids = {str(r["page"]) for r in wanted.collect()}
    some = warc.read_by_index(spark, path, spark.createDataFrame([(i,) for i in ids] * 2, "page string")).collect()
    assert sorted(map(str, some)) == sorted(str(r) for r in by_index.collect() if r["page"] in ids)
    moved = spark.read.parquet(path).withColumn("offsets", F.transform("offsets", lambda x: F.lit(0).cast("long"))).withColumn("frames", F.transform("frames", lambda x: F.lit(0)))
    moved.write.parquet(path + "-moved")
    with pytest.raises(Exception, match="another record than"):
        warc.read_by_index(spark, path + "-moved").collect()
    path, _ = warc.write_archives(df, min_bytes=9)
    assert warc.read_archives(spark, path).filter("record_type = 'revisit'").count() == 0
    path, index = warc.write_archives(df.limit(0))
    assert warc.read_archives(spark, path).count() == 0 and index.count() == 0
