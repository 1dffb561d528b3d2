"""Line templates by a prefix tree of fixed depth.

A line is masked (numbers, hexadecimal names, placeholders in template syntax) and cut into
tokens.  The tree leads by the number of tokens and the first ``DEPTH`` tokens to a leaf with a
few templates; the line joins the template with which it shares the most tokens, if they are
enough, and positions that differ become wildcards.  The cost of a line depends on its leaf, not
on the corpus.  Trees of separate tasks merge by running their templates through one tree.
"""

from __future__ import annotations

import re
from operator import eq

#: Tokens after the count by which the tree branches, and the share of equal tokens to join.
DEPTH, SIMILAR = 2, 0.5
#: Share of equal tokens at which no better template is looked for.
ENOUGH = 0.7
#: Stands for a position at which the lines of a template differ.
WILD = "<*>"

_NAME = r"[A-Za-z][\w.]*(?:[ -][\w.]+){0,3}"
#: Placeholders in template syntax: a name or a call between the marks of a template language.
SLOT = re.compile(
    "|".join(
        [
            r"\{\{\s*NAME\s*\}\}", r"\{%[^%\n]{0,80}%\}", r"[$#]\{\s*NAME\s*\}", r"<%[=-]?[^%\n]{0,80}%>", r"%%NAME%%", r"@@NAME@@", r"\$\$NAME\$\$",
            r"__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__", r"\[\[\s*NAME\s*\]\]", r"«[A-Za-z][\w.]*»", r"<enter NAME>", r"<insert NAME>", r"\[(?:INSERT|Insert|ENTER|Enter) [^\]\n]{1,60}\]",
        ]
    ).replace("NAME", _NAME)
)
_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{5,}(?![A-Za-z0-9])")
_SIGN = re.compile(r" ?\(\d{1,4}[a-zA-Z]?\)")
_DIGIT = re.compile(r"\d")
_MIXED = re.compile(r"[a-f]\d|\d[a-f]")
_NUM = re.compile(r"\d+(?:[.,]\d+)*")
_TOKEN = re.compile(r"<(?:slot|id|num|\*)>|[぀-ゟ]+|[゠-ヿ]+|[㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+|[^\w\s]|_")


def mask(line: str) -> str:
    if "{" in line or "<" in line or "[" in line or "_" in line or "%" in line or "@" in line or "$" in line or "«" in line:
        line = SLOT.sub("<slot>", line)
    if _DIGIT.search(line) is None:
        return line
    if "(" in line and len(line) > 12:
        line = _SIGN.sub("", line)
    if _MIXED.search(line):
        line = _HEX.sub("<id>", line)
    return _NUM.sub("<num>", line)


def tokens(masked: str) -> list[str]:
    return _TOKEN.findall(masked)


class Tree:
    """Templates met so far; ``add`` returns the number of the template of a line."""

    def __init__(self, max_kept: int = 200_000) -> None:
        self.leaves: dict[tuple, list[int]] = {}
        self.templates: list[list[str]] = []
        self.counts: list[int] = []
        self.known: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.max_kept = max_kept

    def add(self, line: str, n: int = 1) -> int:
        """Number of the template of ``line``; lines that are equal once masked share one."""
        at = self.seen.get(line)
        if at is None:
            masked = mask(line)
            at = self.known.get(masked)
            if at is None:
                at = self._place(tokens(masked))
                if len(self.known) >= self.max_kept:
                    self.known.clear()
                self.known[masked] = at
            if len(line) < 120:
                if len(self.seen) >= self.max_kept:
                    self.seen.clear()
                self.seen[line] = at
        self.counts[at] += n
        return at

    def add_template(self, template: str, n: int) -> int:
        # the wildcards of two templates are not an equal token
        at = self._place([f"{WILD}{i}" if w == WILD else w for i, w in enumerate(template.split(" "))])
        self.counts[at] += n
        return at

    def _place(self, words: list[str]) -> int:
        leaf = self.leaves.setdefault((len(words), *words[:DEPTH]), [])
        size = len(words)
        need, enough, best, chosen = SIMILAR * size, ENOUGH * size, -1, -1
        for i, t in enumerate(leaf):
            same = sum(map(eq, self.templates[t], words))
            if same > best:
                best, chosen = same, t
                if same >= enough:
                    if i:  # what was just met comes first next time
                        leaf.insert(0, leaf.pop(i))
                    break
        if chosen < 0 or best < need:
            leaf.append(len(self.templates))
            self.templates.append(words)
            self.counts.append(0)
            return leaf[-1]
        if best < size:
            self.templates[chosen] = [a if a == b else WILD for a, b in zip(self.templates[chosen], words)]
        return chosen

    def text(self, at: int) -> str:
        return " ".join(WILD if w.startswith(WILD) else w for w in self.templates[at])
