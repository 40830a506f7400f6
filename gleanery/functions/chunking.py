"""Sections to chunks of bounded length."""

from __future__ import annotations

MAX_CHARS, OVERLAP = 4000, 400


def split_long(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Parts of at most ``most`` characters, trimmed, blank ones dropped.

    A part ends behind the last paragraph break in its final quarter, else at
    the last white space there, else hard; the next part starts ``overlap``
    characters earlier where the part is longer than that.
    """
    out, start = [], 0
    floor = most * 3 // 4
    while len(text) - start > most:
        window = text[start : start + most]
        # a break counts where the text up to it ends in a blank line
        paragraph = window.rfind("\n\n", floor - 2, most - 1)
        white = next((i for i in range(most - 1, floor - 1, -1) if window[i].isspace()), most)
        end = paragraph + 2 if paragraph >= 0 else white
        out.append(window[:end].strip())
        start += end - overlap if end > overlap else end
    out.append(text[start:].strip())
    return [p for p in out if p]
