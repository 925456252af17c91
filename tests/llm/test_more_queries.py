"""Clips of all media and packed conversations."""

from collections import defaultdict

from terraloom.llm import media, packing
from terraloom.llm.registry import queries


def test_clips_agree_with_features(spark, sf):
    rows = defaultdict(list)
    for r in queries()["media_clips"](spark, sf).collect():
        assert r.error is None and r.end_s > r.start_s
        rows[r.id].append(r)
    features = {r.doc_id: r.feature for r in media.op5_media_columns(spark, sf).collect()}
    assert set(rows) == set(features)
    for k, clips in rows.items():
        clips.sort(key=lambda r: r.clip)
        assert features[k].endswith("shots=" + ",".join(str(r.first_frame) for r in clips))
        assert features[k].startswith(f"frames={sum(r.n_frames for r in clips)};")
        assert all(a.end_s == b.start_s for a, b in zip(clips, clips[1:]))


def test_conversations_are_packed_whole(spark, sf):
    out = packing.instruction_packing(spark, sf).collect()
    words = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        n = len((r.text or "").split())
        words[r.conv_id][0] += n
        words[r.conv_id][1] += n * (r.role == "assistant")
    assert {r.id: [r.tokens, r.loss_tokens] for r in out} == {k: v for k, v in words.items()}
    sums = defaultdict(lambda: [0, 0, 0])
    for r in out:
        if r.sequence_id is None:
            assert r.tokens > 2048 or r.loss_tokens > 1024
        else:
            sums[r.sequence_id] = [a + b for a, b in zip(sums[r.sequence_id], (r.tokens, 1, r.loss_tokens))]
    assert all(a <= 2048 and b <= 16 and c <= 1024 for a, b, c in sums.values())
