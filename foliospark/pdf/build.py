"""Small documents made in code, for tests and for queries over tables that hold no documents."""

from __future__ import annotations

import zlib

import numpy as np

from foliospark.pdf.model import Document, Name, Ref, Stream, number

PAGE = (720, 405)


def image_stream(samples: np.ndarray, mask: Ref | None = None) -> Stream:
    """A lossless image of grey (h, w) or RGB (h, w, 3) samples."""
    entries = {
        "/Type": Name("/XObject"), "/Subtype": Name("/Image"), "/Width": samples.shape[1], "/Height": samples.shape[0], "/BitsPerComponent": 8,
        "/ColorSpace": Name("/DeviceGray" if samples.ndim == 2 else "/DeviceRGB"), "/Filter": Name("/FlateDecode"),
    }
    if mask is not None:
        entries["/SMask"] = mask
    return Stream(entries, zlib.compress(samples.tobytes(), 1))


def empty() -> Document:
    document = Document({}, {})
    pages = document.add({"/Type": Name("/Pages"), "/Kids": [], "/Count": 0})
    document.trailer["/Root"] = document.add({"/Type": Name("/Catalog"), "/Pages": pages})
    return document


def add_page(document: Document, drawn: list[tuple[Ref, tuple, tuple | None]], extra: bytes = b"") -> Ref:
    """A page that draws XObjects: (object, matrix, clip rectangle x y w h or None)."""
    names, content = {}, extra
    for k, (ref, m, clip) in enumerate(drawn):
        names[f"/Im{k}"] = ref
        cut = b" ".join(map(number, clip)) + b" re W n\n" if clip else b""
        content += b"q\n" + cut + b" ".join(map(number, m)) + b" cm\n/Im%d Do\nQ\n" % k
    root = document.get(document.trailer["/Root"])
    tree = document.get(root["/Pages"])
    page = document.add({
        "/Type": Name("/Page"), "/Parent": root["/Pages"], "/MediaBox": [0, 0, *PAGE], "/Resources": {"/XObject": names}, "/Contents": document.add(Stream({}, content)),
    })
    tree["/Kids"].append(page)
    tree["/Count"] += 1
    return page


def gradient(w: int = 800, h: int = 450) -> np.ndarray:
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([40 + 180 * x // w, 20 + 60 * y // h, 200 - 60 * x // w], -1).astype(np.uint8)


def noisy(w: int = 400, h: int = 300, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    base = (128 + 100 * np.sin(x / 23) * np.cos(y / 17))[..., None]
    return np.clip(base + rng.integers(-40, 41, (h, w, 3)), 0, 255).astype(np.uint8)
