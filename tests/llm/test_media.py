import hashlib
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from cairn.llm import media


@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == data.rstrip(b"\0")
    assert media.load(media.store(payload)) == payload


def test_described():
    for text in (None, "", "a", "é" * 32, "x" * 64, "word " * 200_000):
        data = (text or "").encode()
        payload = media.padded(data)
        found = media.described(text)
        assert found[:4] == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert found[5] == hashlib.sha256(media.store(payload)).hexdigest() and found == media.described(text)


def test_tone_is_found_in_every_block():
    t = np.arange(media.HOP * (media.FRAMES_AT_ONCE + 10))
    tone = (128 + 100 * np.sin(2 * np.pi * t * 40 / media.FRAME)).astype(np.uint8)
    spectrum = np.concatenate(list(media.spectrum(tone)))
    assert len(spectrum) == -(-(len(t) - media.FRAME) // media.HOP) + 1
    assert (spectrum[:, 24:72].argmax(1)[:-1] + 24 == 40).all()


def brute(payload):
    """Peaks and pairs by plain loops."""
    signal = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = max(1, -(-(len(signal) - media.FRAME) // media.HOP) + 1)
    signal = np.pad(signal, (0, (n - 1) * media.HOP + media.FRAME - len(signal)))
    frames = [np.abs(np.fft.rfft(signal[i * media.HOP : i * media.HOP + media.FRAME] * media._WINDOW)) ** 2 for i in range(n)]
    out = []
    for low, high in zip(media.BANDS, media.BANDS[1:]):
        best = [(int(f[low:high].argmax()) + low, f[low:high].max()) for f in frames]
        peaks = [i for i in range(n) if best[i][1] > 0 and best[i][1] == max(p for _, p in best[max(0, i - media.NEAR) : i + media.NEAR + 1])]
        for k, a in enumerate(peaks):
            out += [(best[a][0] << 18 | best[b][0] << 9 | (b - a)) << 32 | a for b in peaks[k + 1 : k + 4] if b - a <= media.REACH]
    return sorted(out)


def test_fingerprints_against_loops():
    for text in ("a", "the quick brown fox " * 100, "ab" * 5000, "z" * 3000):
        payload = media.padded(text.encode())
        assert sorted(media.fingerprints(payload).tolist()) == brute(payload)


def test_frame(spark):
    rows = spark.createDataFrame([(1, "Hello there " * 90, "x"), (2, None, "y"), (1, "Hello there " * 90, "z"), (None, "", "w")], "doc_id bigint, text string, media string")
    found = media.media_columns(rows).collect()
    assert sorted(len(media.load(bytes(r.media))) for r in found) == [64, 64, 1088, 1088]
    assert all(r.fingerprints == media.fingerprints(media.load(bytes(r.media))).tolist() for r in found)
    assert media.media_columns(rows.limit(0)).count() == 0
