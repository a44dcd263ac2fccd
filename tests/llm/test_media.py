import hashlib
import zlib

import numpy as np
from helpers import SCHEMA, documents, frame

from paperloom.llm import media as M


def test_round_trip_and_digests(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in M.op7_media(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in documents():
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[doc_id][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = M.write_wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and M.read_wav(media) == payload
    assert got[3][0]["feature"] == got[24][0]["feature"] != got[4][0]["feature"]
    assert len(got[2]) == 3 and len(got[None]) == 1
    assert M.to_media(frame(spark, [], SCHEMA)).count() == 0


def test_peaks_follow_the_tone():
    t = np.arange(M.RATE)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / M.RATE)).astype(np.uint8).tobytes()
    bins, strength = M.band_peaks(tone)
    assert (bins[5:-5][:, strength[5:-5].mean(axis=0).argmax()] == round(1000 * M.FRAME / M.RATE)).all()
    times, codes = M.fingerprint(bytes(64))
    assert len(times) == len(codes) == 0


def test_fingerprint_is_found_in_a_longer_recording(monkeypatch):
    rng = np.random.default_rng(4)
    clip = rng.integers(0, 256, 128 * 90, dtype=np.uint8).tobytes()
    longer = rng.integers(0, 256, 128 * 40, dtype=np.uint8).tobytes() + clip
    t, c = M.fingerprint(clip)
    inside = dict.fromkeys(zip(*(x.tolist() for x in M.fingerprint(longer))))
    hits = sum((a + 40, b) in inside for a, b in zip(t.tolist(), c.tolist()))
    assert hits > 0.8 * len(t)
    monkeypatch.setattr(M, "BLOCK_FRAMES", 7)  # blocks don't change the result
    again = M.fingerprint(clip)
    assert (again[0] == t).all() and (again[1] == c).all()


def test_fingerprint_by_brute_force():
    """A transform summed term by term, peaks and pairs found by plain loops, give the same times and codes."""
    import cmath
    import math

    rng = np.random.default_rng(4)
    samples = bytes(rng.integers(0, 256, 1400, dtype=np.uint8))
    frames = []
    for start in range(0, len(samples) - 256 + 128, 128):
        part = [samples[min(start + k, len(samples) - 1)] / 128 - 1 for k in range(256)]
        mean = sum(part) / 256
        shaped = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * k / 255)) for k, v in enumerate(part)]
        frames.append([abs(sum(v * cmath.exp(-2j * math.pi * f * k / 256) for k, v in enumerate(shaped))) for f in range(129)])
    tops = [[max((frame[f], -f) for f in range(a, b)) for a, b in zip(M.BANDS, M.BANDS[1:])] for frame in frames]
    peaks = []
    for t, bands in enumerate(tops):
        for k, (strength, f) in enumerate(bands):
            before = tops[t - 1][k][0] if t else 0
            after = tops[t + 1][k][0] if t + 1 < len(tops) else 0
            if strength > 1e-3 and strength >= before and strength > after:
                peaks.append((t, -f))
    pairs = sorted((t, (f << 14) | (g << 6) | (u - t)) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + M.FAN_OUT] if u - t <= 63)
    times, codes = M.fingerprint(samples)
    assert list(zip(times.tolist(), codes.tolist())) == pairs
