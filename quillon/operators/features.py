"""Feature extraction from images and sound: a registry of methods, run over files by Arrow batches.

WAV sound and netpbm images are read here; other formats, and local descriptors or
networks for images, need OpenCV, librosa or torch, which are used where they are installed.
A file that cannot be read has no feature and no row.
"""

from __future__ import annotations

import importlib.util
import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import media
from quillon.runtime import stage

#: Settings of the sound features.
RATE, SECONDS, N_FFT, HOP, N_MELS, N_MFCC = 22050, 30, 2048, 512, 128, 13
#: Methods that give many local descriptors an item, to be put in words by a codebook.
DESCRIPTOR_METHODS = ("sift",)


def read_sound(content: bytes, seconds: float | None = SECONDS) -> np.ndarray:
    """Samples of a sound file as mono at the common rate."""
    if content[:4] == b"RIFF":
        with wave.open(io.BytesIO(content)) as w:
            n = w.getnframes() if seconds is None else min(w.getnframes(), int(seconds * w.getframerate()))
            raw, width, rate = w.readframes(n), w.getsampwidth(), w.getframerate()
            kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
            x = np.frombuffer(raw, kind).astype(np.float64).reshape(-1, w.getnchannels()).mean(1)
            x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
        at = np.arange(0, len(x), rate / RATE)
        return np.interp(at, np.arange(len(x)), x) if rate != RATE and len(x) else x
    import librosa

    return librosa.load(io.BytesIO(content), sr=RATE, duration=seconds)[0]


def _power(x: np.ndarray) -> np.ndarray:
    """Power spectrum of windowed frames, one row a frame."""
    x = np.pad(x, N_FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(N_FFT + 1)[:-1], axis=1)) ** 2


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 2), N_MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(N_FFT, 1 / RATE)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def _mean_and_deviation(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows.mean(0), rows.std(0)])


def _mel_db(power: np.ndarray) -> np.ndarray:
    m = np.maximum(power @ _mel_bank().T, 1e-10)
    return np.maximum(10 * np.log10(m), 10 * np.log10(m.max()) - 80)


def _cepstrum(power: np.ndarray) -> np.ndarray:
    k = np.arange(N_MELS)
    basis = np.cos(np.pi / N_MELS * (k[None] + 0.5) * np.arange(N_MFCC)[:, None]) * np.sqrt(2 / N_MELS)
    basis[0] /= np.sqrt(2)
    return _mel_db(power) @ basis.T


def mfcc(content: bytes) -> np.ndarray:
    """Mean and deviation of 13 cepstral coefficients."""
    return _mean_and_deviation(_cepstrum(_power(read_sound(content))))


def mel_spectrogram(content: bytes) -> np.ndarray:
    """Mean and deviation of 128 mel bands in dB, over the whole sound."""
    return _mean_and_deviation(_mel_db(_power(read_sound(content, None))))


def comprehensive(content: bytes) -> np.ndarray:
    """Cepstrum, centroid, roll-off, zero crossings and chroma: 56 numbers."""
    x = read_sound(content, None)
    power = _power(x)
    f, size = np.fft.rfftfreq(N_FFT, 1 / RATE), np.sqrt(power)
    total = np.maximum(size.sum(1), 1e-10)
    centroid = (size @ f) / total
    rolloff = f[(np.cumsum(size, 1) >= 0.85 * total[:, None]).argmax(1)]
    padded = np.pad(x, N_FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(np.signbit(padded), N_FFT)[::HOP]
    crossings = (frames[:, 1:] != frames[:, :-1]).mean(1)
    pitch = np.round(12 * np.log2(np.maximum(f, 1e-6) / 440)).astype(int) % 12
    chroma = np.stack([power[:, (pitch == p) & (f > 27)].sum(1) for p in range(12)], axis=1)
    chroma /= np.maximum(chroma.max(1, keepdims=True), 1e-10)
    parts = [_mean_and_deviation(_cepstrum(power))] + [np.array([v.mean(), v.std()]) for v in (centroid, rolloff, crossings)]
    return np.concatenate([*parts, _mean_and_deviation(chroma)])


def read_image(content: bytes) -> np.ndarray:
    """Pixels of an image as rows x columns x RGB."""
    if content[:2] in (b"P5", b"P6"):
        head, at = [], 2
        while len(head) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            head.append(int(content[at:end]))
            at = end
        channels = 3 if content[:2] == b"P6" else 1
        x = np.frombuffer(content, np.uint8, head[0] * head[1] * channels, at + 1).reshape(head[1], head[0], channels)
        return np.repeat(x, 3, 2) if channels == 1 else x
    import cv2

    return cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)[..., ::-1]


def rgb_histogram(content: bytes) -> np.ndarray:
    """16 bins of each colour at length 1."""
    x = read_image(content)
    h = np.concatenate([np.bincount(x[..., c].reshape(-1) >> 4, minlength=16) for c in range(3)]).astype(np.float64)
    return h / (np.linalg.norm(h) + 1e-7)


def sift(content: bytes) -> np.ndarray:
    """Local descriptors, n x 128."""
    import cv2

    gray = cv2.cvtColor(np.ascontiguousarray(read_image(content)), cv2.COLOR_RGB2GRAY)
    found = cv2.SIFT_create().detectAndCompute(gray, None)[1]
    if found is None:
        raise ValueError("no descriptor")
    return found


def _network(name: str, size: int) -> Callable[[bytes], np.ndarray]:
    """The pooled last layer of a network with weights that are on the machine."""
    state: dict = {}

    def run(content: bytes) -> np.ndarray:
        import torch
        import torchvision

        if not state:
            model = getattr(torchvision.models, name)(weights="IMAGENET1K_V1")
            model.fc = torch.nn.Identity()
            state["model"] = model.eval()
        x = torch.from_numpy(np.ascontiguousarray(read_image(content))).permute(2, 0, 1)[None].float() / 255
        with torch.no_grad():
            return state["model"](torch.nn.functional.interpolate(x, (size, size), mode="bilinear"))[0].numpy()

    return run


#: Methods by medium: the function, and the modules it needs.
METHODS: dict[str, dict[str, tuple[Callable[[bytes], np.ndarray], tuple[str, ...]]]] = {
    "image": {
        "rgb_histogram": (rgb_histogram, ()),
        "sift": (sift, ("cv2",)),
        "resnet50": (_network("resnet50", 224), ("torch", "torchvision")),
        "inception_v3": (_network("inception_v3", 299), ("torch", "torchvision")),
    },
    "audio": {"mfcc": (mfcc, ()), "melspectrogram": (mel_spectrogram, ()), "comprehensive": (comprehensive, ())},
}


def register(medium: str, name: str, function: Callable[[bytes], np.ndarray], needs: tuple[str, ...] = ()) -> None:
    """Add a method of one's own."""
    METHODS.setdefault(medium, {})[name] = (function, needs)


def available() -> dict[str, list[str]]:
    """The methods whose modules are installed, by medium."""
    there = lambda needs: all(importlib.util.find_spec(m) for m in needs)
    return {medium: [n for n, (_, needs) in methods.items() if there(needs)] for medium, methods in METHODS.items()}


def file_content(path: str) -> bytes:
    """The bytes of a file, by path or by the URI of any file system Arrow knows."""
    where, name = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)
    with where.open_input_stream(name) as f:
        return f.read()


def _method(medium: str, name: str) -> Callable[[bytes], np.ndarray]:
    if name not in METHODS.get(medium, {}):
        raise ValueError(f"methods for {medium} are {sorted(METHODS.get(medium, {}))}")
    if name not in available()[medium]:
        raise ValueError(f"{name} needs {METHODS[medium][name][1]}")
    return METHODS[medium][name][0]


def extract(rows: DataFrame, path_col: str, medium: str, method: str) -> DataFrame:
    """(path, feature) of the files rows point to; for local descriptors a row each. Unreadable files are left out."""
    function = _method(medium, method)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = [], []
            for path in batch.column("path").to_pylist():
                try:
                    value = np.atleast_2d(function(file_content(path)))
                except (OSError, EOFError, ValueError, IndexError, wave.Error, struct.error):  # not there, or not readable as what it should be
                    continue
                paths += [path] * len(value)
                found += [v.astype(np.float32) for v in value]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.list_(pa.float32()))], ["path", "feature"])

    paths = rows.select(F.col(f"`{path_col}`").alias("path")).filter("path is not null").distinct()
    return paths.mapInArrow(run, "path string, feature array<float>").withColumnRenamed("path", path_col)


def codebook_index(descriptors: DataFrame, path_col: str, clusters: int) -> media.MediaIndex:
    """An index over bags of visual words."""
    rows = stage(descriptors, "descriptors")
    means, deviations = media._fixed(rows.sparkSession, media.scaler(rows, "feature"))
    centroids = media.fit_codebook(rows, "feature", clusters)
    unit = rows.withColumn("feature", media.scaled(F.col("feature"), means, deviations))
    hist = stage(media.bag_of_words(media.assigned_words(unit, path_col, "feature", centroids), clusters), "histograms")
    return media.index_histograms(hist)


def of_file(path: str, method: str) -> list[float]:
    """The feature of one file."""
    medium = next((m for m, methods in METHODS.items() if method in methods), None)
    if medium is None:
        raise ValueError(f"{path!r} is not in the table, and {method!r} is no method to extract with")
    return np.asarray(_method(medium, method)(file_content(path)), float).reshape(-1).tolist()
