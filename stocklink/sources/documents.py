"""Text of scanned and printed documents: whatever tools the machine has are tried, and the attempt that reads best counts.

All tools are optional; without any, a document is reported as unreadable.
Boxes that a recogniser returns are put together to rows here.
"""

from __future__ import annotations

import importlib.util
import platform
import shutil
import statistics
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import UNREADABLE

IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
TOOLS = ("pdftotext", "pdftoppm", "tesseract", "ocrmypdf")
SECONDS = 300


@dataclass
class Attempt:
    mode: str
    pages: int = 0
    lines: list[tuple[int, int, str, float]] = field(default_factory=list)  # page, number, text, confidence
    warnings: list[str] = field(default_factory=list)

    @property
    def score(self) -> float:
        """Characters, lines and mean confidence, less the warnings."""
        # fixed values: the weights
        if not self.lines:
            return -1.0
        return len("\n".join(x[2] for x in self.lines).strip()) + 24.0 * len(self.lines) + 40.0 * statistics.fmean(x[3] for x in self.lines) - 10.0 * len(self.warnings)


def available() -> dict[str, bool]:
    """Which tools there are."""
    found = {t: shutil.which(t) is not None for t in TOOLS}
    recogniser = all(importlib.util.find_spec(m) for m in ("paddleocr", "PIL"))
    return found | {"paddleocr": recogniser, "swift_vision": platform.system() == "Darwin" and shutil.which("swift") is not None}


def _run(command: list[str], attempt: Attempt) -> str | None:
    try:
        done = subprocess.run(command, capture_output=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired) as error:
        attempt.warnings.append(f"{command[0]}: {error}")
        return None
    if done.returncode:
        attempt.warnings.append(f"{command[0]}: {done.stderr.decode('utf-8', 'replace')[:200]}")
        return None
    return done.stdout.decode("utf-8", "replace")


def lines_of(text: str, confidence: float) -> list[tuple[int, int, str, float]]:
    """Lines of a text whose pages are parted by form feeds; blank ones are left out."""
    return [(p, k, line.strip(), confidence) for p, page in enumerate(text.split("\f"), 1) for k, line in enumerate(page.splitlines(), 1) if line.strip()]


def _printed(path: Path, folder: Path) -> Attempt:
    attempt = Attempt("pdftotext")
    text = _run(["pdftotext", "-layout", str(path), "-"], attempt)
    if text:
        attempt.lines, attempt.pages = lines_of(text, 0.98), text.count("\f") or 1
    return attempt


def _scanned(path: Path, folder: Path) -> Attempt:
    attempt, out = Attempt("ocrmypdf"), folder / "read.pdf"
    if _run(["ocrmypdf", "--skip-text", "-l", "rus+eng", str(path), str(out)], attempt) is not None and out.exists():
        text = _run(["pdftotext", "-layout", str(out), "-"], attempt)
        if text:
            attempt.lines, attempt.pages = lines_of(text, 0.9), text.count("\f") or 1
    return attempt


def _pages_by_image(path: Path, folder: Path) -> Attempt:
    attempt = Attempt("poppler_tesseract")
    if _run(["pdftoppm", "-r", "200", "-png", str(path), str(folder / "page")], attempt) is None:
        return attempt
    for number, image in enumerate(sorted(folder.glob("page*.png")), 1):
        text = _run(["tesseract", str(image), "-", "-l", "rus+eng"], attempt)
        attempt.lines += [(number, k, line, c) for _, k, line, c in lines_of(text or "", 0.8)]
        attempt.pages = number
    return attempt


def _image(path: Path, folder: Path) -> Attempt:
    """The page mode that reads best."""
    tries = []
    for mode in ("6", "11"):
        attempt = Attempt(f"tesseract_psm{mode}", 1)
        text = _run(["tesseract", str(path), "-", "-l", "rus+eng", "--psm", mode], attempt)
        attempt.lines = lines_of(text or "", 0.8)
        tries.append(attempt)
    return max(tries, key=lambda a: a.score)


READERS: dict[str, list[tuple[tuple[str, ...], Callable[[Path, Path], Attempt]]]] = {"pdf": [(("pdftotext",), _printed), (("ocrmypdf", "pdftotext"), _scanned), (("pdftoppm", "tesseract"), _pages_by_image)], "image": [(("tesseract",), _image)]}


def kind_of(name: str) -> str:
    suffix = Path(name).suffix.lower()
    if suffix == ".pdf":
        return "pdf"
    if suffix in IMAGES:
        return "image"
    raise ValueError(f"this kind of document isn't supported: {name}")


def best(attempts: list[Attempt]) -> Attempt:
    """The attempt that scores most, with the warnings of all; without any text an unreadable one."""
    warnings = [w for a in attempts for w in a.warnings]
    chosen = max((a for a in attempts if a.lines), key=lambda a: a.score, default=None)
    if chosen is None:
        return Attempt("unreadable", warnings=warnings or [UNREADABLE])
    return Attempt(chosen.mode, chosen.pages, chosen.lines, warnings)


def read_document(name: str, data: bytes) -> Attempt:
    have, kind = available(), kind_of(name)
    with tempfile.TemporaryDirectory() as folder:  # for the tools of this one task; nothing else reads it
        path = Path(folder) / f"document{Path(name).suffix.lower()}"
        path.write_bytes(data)
        return best([reader(path, Path(folder)) for tools, reader in READERS[kind] if all(have[t] for t in tools)])


LINES = "path string, kind string, mode string, pages int, page int, row long, text string, confidence double, warnings array<string>"


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the documents that match; one that can't be read gives one row without text, with the warnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = read_document(name, data)
                rows = read.lines or [(0, 0, None, None)]
                n = len(rows)
                yield pa.record_batch(
                    [pa.array([name] * n), pa.array([kind_of(name)] * n), pa.array([read.mode] * n), pa.array([read.pages] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array(range(n), pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64()), pa.array([read.warnings] * n, pa.list_(pa.string()))],
                    names=[c.split()[0] for c in LINES.split(", ")],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, LINES)


# Boxes to rows


@dataclass
class Box:
    text: str
    confidence: float
    left: float
    top: float
    bottom: float

    @property
    def middle(self) -> float:
        return (self.top + self.bottom) / 2

    @property
    def height(self) -> float:
        return max(self.bottom - self.top, 1.0)


@dataclass
class Row:
    boxes: list[Box]

    @property
    def top(self) -> float:
        return min(b.top for b in self.boxes)

    @property
    def bottom(self) -> float:
        return max(b.bottom for b in self.boxes)

    @property
    def text(self) -> str:
        return " | ".join(b.text.strip() for b in sorted(self.boxes, key=lambda b: b.left))

    @property
    def confidence(self) -> float:
        return statistics.fmean(b.confidence for b in self.boxes)


def boxes_of(found: list) -> list[Box]:
    """Boxes of a recogniser's result: (four corners, (text, confidence)); blank ones are left out."""
    if found and isinstance(found[0], list) and found[0] and len(found[0][0]) == 2 and isinstance(found[0][0][1], (list, tuple)) and isinstance(found[0][0][1][0], str):
        found = found[0]
    out = []
    for corners, (text, confidence, *_) in found or []:
        if str(text).strip():
            ys = [float(y) for _, y in corners]
            out.append(Box(str(text).strip(), float(confidence or 0), min(float(x) for x, _ in corners), min(ys), max(ys)))
    return out


def rows_of(boxes: list[Box]) -> list[Row]:
    """Boxes of about the same height on the page make a row; a sparse row without a number that follows closely goes on the row before."""
    if not boxes:
        return []
    # fixed values: the tolerances
    reach = max(12.0, 1.55 * statistics.median(b.height for b in boxes))
    rows: list[Row] = []
    for box in sorted(boxes, key=lambda b: (b.middle, b.left)):

        def apart(row: Row, box: Box = box) -> float:
            return abs(box.middle - (row.top + row.bottom) / 2)

        near = [r for r in rows if apart(r) <= max(reach, 1.25 * (r.bottom - r.top)) or min(box.bottom, r.bottom) - max(box.top, r.top) >= 0.25 * min(box.height, r.bottom - r.top)]
        if near:
            min(near, key=apart).boxes.append(box)
        else:
            rows.append(Row([box]))
    out: list[Row] = []
    for row in sorted(rows, key=lambda r: (r.top + r.bottom) / 2):
        goes_on = out and len(row.boxes) <= 2 and not any(c.isdigit() for c in row.text) and row.top - out[-1].bottom <= 0.8 * reach
        if goes_on:
            out[-1] = Row([*out[-1].boxes, *row.boxes])
        else:
            out.append(row)
    return out


def rows_score(rows: list[Row]) -> float:
    # fixed values: the weights
    return sum(len(r.text) + 18.0 * r.text.count("|") + 6.0 for r in rows) + 40.0 * statistics.fmean(r.confidence for r in rows) if rows else 0.0
