"""PDF pages through the poppler command line tools, where executors have them: page count, text layer, boxes, images, rendered page."""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

#: Seconds that a tool may take, and rendering may take; dots an inch.
SECONDS, RENDER_SECONDS, DPI = 60, 120, 300

#: A command and its time limit to what it prints; raises if it fails.
Run = Callable[[list[str], int], bytes]


def run_tool(command: list[str], seconds: int) -> bytes:
    return subprocess.run(command, check=True, capture_output=True, timeout=seconds).stdout


def page_count(info: str) -> int:
    if not (found := re.search(r"^Pages:\s*(\d+)", info, re.M)):
        raise ValueError("no page count")
    return int(found[1])


def image_areas(listing: str) -> list[int]:
    """Pixel counts in an image listing; lines that don't begin with page, number, type, width and height are passed over."""
    cells = (line.split() for line in listing.splitlines())
    return [int(c[3]) * int(c[4]) for c in cells if len(c) > 4 and c[0].isdigit() and c[3].isdigit() and c[4].isdigit()]


def left_edges(tsv: str) -> list[float]:
    """Left edges of the text boxes (level 5) as parts of the width of the page that comes before them (level 1); rows with odd numbers are passed over."""
    out, width = [], 0.0
    for row in (line.split("\t") for line in tsv.splitlines()[1:]):
        try:
            left, _, wide, _ = map(float, row[6:10]) if len(row) >= 11 else ()
        except ValueError:
            continue
        if row[0] == "1":
            width = wide
        elif row[0] == "5" and width > 0:
            out.append(left / width)
    return out


def pdf_reader(run: Run = run_tool) -> Callable[[bytes], Iterator]:
    """A function for read_case_files(): PDF bytes to pages, each of which is read, and fails, on its own. Files are the task's own and gone after it."""

    def pages(data: bytes) -> Iterator:
        with tempfile.TemporaryDirectory() as folder:
            file = f"{folder}/in.pdf"
            Path(file).write_bytes(data)

            def read(n: int) -> tuple[str, list[int], list[float], bytes]:
                only = ["-f", str(n), "-l", str(n)]
                layer = run(["pdftotext", "-layout", *only, file, "-"], SECONDS).decode("utf-8", "replace")
                areas = image_areas(run(["pdfimages", "-list", *only, file], SECONDS).decode("utf-8", "replace"))
                lefts = left_edges(run(["pdftotext", "-tsv", *only, file, "-"], SECONDS).decode("utf-8", "replace"))
                picture = Path(f"{folder}/page-{n}.png")
                run(["pdftoppm", "-png", "-singlefile", "-r", str(DPI), *only, file, str(picture.with_suffix(""))], RENDER_SECONDS)
                return layer, areas, lefts, picture.read_bytes()

            for n in range(1, page_count(run(["pdfinfo", file], SECONDS).decode("utf-8", "replace")) + 1):
                yield n, lambda n=n: read(n)

    return pages
