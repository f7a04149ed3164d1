"""Getting files from outside, before Spark: pages with a cache, PDFs that resume, page images
put through a recogniser.  The opener and the recogniser are parameters."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable


def _open(url: str, timeout: float) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:
        return r.read()


def page(url: str, cache: str, opener: Callable[[str, float], bytes] = _open, timeout: float = 30) -> str:
    """A page's text, from the cache file if there is one; what is fetched is kept for good."""
    if os.path.exists(cache):
        with open(cache, encoding="utf-8") as f:
            return f.read()
    body = opener(url, timeout).decode("utf-8", "replace")
    os.makedirs(os.path.dirname(cache) or ".", exist_ok=True)
    with open(cache, "w", encoding="utf-8") as f:
        f.write(body)
    return body


def pdfs(items: Iterable[tuple[str, str]], folder: str, opener: Callable[[str, float], bytes] = _open, timeout: float = 60, pause: float = 0.3) -> dict[str, int]:
    """Download ``(id, url)`` items; counts of ``ok``, ``skip`` and ``fail``.

    A file of more than 1,000 bytes is there already; what does not begin like a PDF fails.
    """
    os.makedirs(folder, exist_ok=True)
    count = {"ok": 0, "skip": 0, "fail": 0}
    for name, url in items:
        target = os.path.join(folder, f"{name}.pdf")
        if os.path.exists(target) and os.path.getsize(target) > 1000:
            count["skip"] += 1
            continue
        try:
            body = opener(url, timeout)
            if not body.startswith(b"%PDF"):
                raise ValueError("not a PDF")
        except (OSError, ValueError):
            count["fail"] += 1
            continue
        with open(target + ".part", "wb") as f:
            f.write(body)
        os.replace(target + ".part", target)
        count["ok"] += 1
        time.sleep(pause)
    return count


def recognise(contract_id: str, images: Iterable[bytes], target: str, recogniser: Callable[[bytes], tuple[str, float]], engine: str) -> dict | None:
    """Recognised pages of a document written as JSON, None if they are there; a page that fails is a row with its error."""
    if os.path.exists(target):
        return None
    pages = []
    for k, image in enumerate(images, 1):
        try:
            text, confidence = recogniser(image)
            pages.append({"page": k, "text": text, "confidence": confidence, "char_count": len(text)})
        except Exception as e:  # noqa: BLE001  any failure is that page's
            pages.append({"page": k, "error": str(e)})
    out = {"contract_id": contract_id, "engine": engine, "pages": pages}
    with open(target, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False)
    return out
