import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import best_fit_packing as packing
from ledgerloom.llm import bpe, chat_format

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_encode_and_decode(hard, hard_texts, none, tmp_path):
    texts = [*hard_texts, (None, "no identifier at all")]
    own = bpe.tokenizer_of(WORD)
    hard.select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    docs = hard.sparkSession.read.parquet(str(tmp_path / "docs"))
    got = bpe.encode(docs, WORD, block_bytes=4000)
    want = Counter((i, tuple(own.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    decoded = Counter((r.doc_id, r.decoded) for r in bpe.decode_ids(got, WORD).collect())
    assert decoded == Counter((i, own.decode(list(ids), skip_special_tokens=False)) for i, ids in want.elements())
    assert bpe.encode(none, WORD).count() == 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(list(ids), skip_special_tokens=False))) for i, ids in want.elements())
    assert Counter(map(tuple, bpe.digests(docs, WORD, block_bytes=4000).collect())) == want


def test_op3_bpe_gives_what_the_library_gives(spark, small):
    own = bpe.tokenizer_of(WORD)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    got = bpe.op3_bpe(spark, small).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_other_blocks_are_noticed(spark):
    """Rows that change between the two scans raise, even where the numbers of words stay."""

    def texts(batches):
        import os

        for batch in batches:
            yield batch.assign(text=[os.urandom(8).hex() for _ in range(len(batch))])

    df = spark.range(200).withColumnRenamed("id", "doc_id").mapInPandas(texts, "doc_id long, text string")
    with pytest.raises(Exception, match="cut different blocks"):
        bpe.digests(df, WORD).collect()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab's 1é\n\t\x1c\x85\xa0　<|endoftext|>.ß3"), max_size=60))
def test_words_are_encoded_as_the_whole(text):
    encoder = packing.encoder_of(BYTE)
    assert encoder.ids(text) == encoder.raw(text)


def test_packing(hard, hard_texts, none):
    texts = [*hard_texts, (None, "no identifier at all")]
    encoder = packing.encoder_of(BYTE)
    rows = packing.pack_documents(hard, BYTE).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in texts:
        ids = np.frombuffer(encoder.raw(t or ""), "<u4").tolist() + [2]
        own = sorted(pieces[i], key=lambda r: (r.start, r.sequence_id))
        if i == 300:  # a row that is there twice
            own = own[::2]
        assert [r.start for r in own] == [s for s, _ in packing.cut(len(ids), 1024)]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack_documents(none, BYTE).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
def test_plan_uses_every_piece_once(counts):
    out = packing.plan(counts, 60)
    used = Counter()
    for bin_, times in out:
        assert sum(bin_) <= 60
        for x in bin_:
            used[x] += times
    assert used == Counter(counts)
    assert sum(t for _, t in out) <= 11 * sum(k * v for k, v in counts.items()) / 9 / 60 + sum(counts.values()) * 0.5 + 1


def turns(spark):
    hard = r"</s>[INST] \ok\\ [/INST] <|im_start|>user" + "\n<|im_end|>\n\\<|x"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", hard), (1, 2, "assistant", hard * 40), (1, 3, "user", None), (1, 4, "assistant", "b" * 30), (1, 4, "assistant", "b" * 30), (2, None, None, "x"), (2, 1, "assis\ntant\\", ""), (3, 0, "system", "alone"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * (k % 13)) for k in range(120)]
    return rows, spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, window int, tokens int")


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 20), (60, 0), (5, 2)])
def test_chat_windows(spark, budget, history):
    rows, df = turns(spark)
    windows = chat_format.format_windows(df, BYTE, budget, history)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tokenizer = chat_format.counter_of(BYTE)
    for w in windows.collect():
        new = w.n_turns - w.n_repeated
        assert new >= 1
        if new > 1 and budget > 100:
            assert len(tokenizer.encode(w.text, add_special_tokens=False).ids) <= budget
        if w.conv_id == 1 and budget > 50:
            assert w.text.startswith("<|im_start|>system\nbe kind")
    assert sum(r.n_turns for r in got.values()) == len(rows)


def test_a_long_system_turn_is_not_repeated(spark):
    rows = [(1, 0, "system", "word " * 900)] + [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 41)]
    windows = chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE).collect()
    assert sum("<|im_start|>system" in w.text for w in windows) == 1 and sum(len(w.text) for w in windows) < 3 * 5000
    short = [(1, 0, "system", "word " * 300), *((1, k, "user", "word " * 200) for k in range(1, 9))]
    windows = chat_format.format_windows(spark.createDataFrame(short, "conv_id long, turn long, role string, text string"), BYTE).collect()
    assert len(windows) > 3 and all(w.text.startswith("<|im_start|>system") for w in windows)


def test_op2_chat_format_reads_all_conversations_back(spark, small):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        said[r.conv_id].append((r.role, r.text or ""))
    said[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for conv, turns in said.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.op2_chat_format(spark, small).collect()}
    assert got == want


def test_no_chats(spark):
    _, df = turns(spark)
    assert chat_format.read_back(chat_format.format_windows(df.limit(0), BYTE)).count() == 0
