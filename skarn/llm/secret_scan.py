"""Secret scan: fixed patterns, and strings whose marginal compressed size shows them to be random.

A candidate is a long string near a sensitive word.  Its novelty is what it
adds to the zstandard size of the code around it, the compressor primed with a dictionary of
identifiers, some fixed and some learnt from the texts themselves: names, paths and prose cost little, keys cost nearly
all their bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER, UPPER, slices

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words whose neighbourhood is sensitive.
SENSITIVE = re.compile(r"password|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth(?:orization)?|bearer|signature")
SENSITIVE_ANY_CASE = re.compile(SENSITIVE.pattern, re.I)
#: What is left of a name after a sensitive word in it, if a value is assigned to the name.
REST = re.compile(r"""[A-Za-z_-]{1,40}(?=["'\]]{0,2}\x20*[:=])""")
CANDIDATE, CANDIDATE_CHAR = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile(r"[A-Za-z0-9+/_=-]")
#: Characters of a candidate that a search for its place sees; longer ones are then followed to their ends.
LONGEST = 512
#: Identifiers and words that code is full of; the compressor knows them beforehand.
IDENTIFIERS = """
abstract access account address algorithm application argument array assert async attribute authorization await base64 boolean
buffer bytes cache callback certificate character class client config configuration connection const constructor container content
context controller counter create credential current database datetime debug decode default define delete description destination
dictionary directory document element encode endpoint environment error example exception execute expires export extends false field
filename filter float format function generate getattr handler hashlib header hexdigest host http https identifier implements import
index input insert instance integer interface iterator javascript keyword lambda language length library license listener localhost
location logger manager message metadata method module namespace network null number object offset operator option organization output
package parameter parent password path pattern payload permission port private process project property protected protocol provider
public python query random read record redirect reference register release remote repository request require resource response result
return schema script secret select sequence serialize server service session setting signature source static status storage stream string
struct super switch table target template test text thread timeout timestamp token transaction transform true type undefined update upload
user username utf-8 validate value variable version void while width window worker write 0123456789 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ example.com sha256 uuid xxxxxxxxxxxxxxxx 0000000000000000
"""
#: Characters between a candidate and a sensitive word; of context on either side that the compressor has seen before the candidate.
NEAR, AROUND = 48, 256
#: Bits that each of a candidate's first SHORT characters must cost to be called random (random letters and digits cost 8 and more, identifiers of known words 5), and share of its alphabet's entropy for the others.
BITS, SHORT, ENTROPY = 7.7, 40, 0.9
#: The alphabets of keys, the smallest first.
DIGITS = "0123456789"
ALPHABETS = [set(a) for a in (DIGITS, DIGITS + LOWER[:6], DIGITS + UPPER[:6], LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, LOWER + UPPER, DIGITS + LOWER + UPPER, DIGITS + LOWER + UPPER + "+/_=-")]
HAS_DIGIT = re.compile("[0-9]")
#: Words of an identifier: by marks and changes of case.
WORD = re.compile("[A-Z]?[a-z]{3,15}|[A-Z]{4,16}(?![a-z])")
#: Words that a dictionary learnt from the texts takes at most, and texts that must hold a word.
LEARNT, TEXTS = 4096, 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Novelty:
    """Marginal compressed size, by a compressor primed with identifiers that reads the context first."""

    def __init__(self, dictionary: bytes = b""):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary + " ".join(IDENTIFIERS.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=19)
        self.zstd = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)

    def bits(self, before: str, candidate: str, after: str) -> int:
        """What the candidate adds to the compressed size of the code around it."""
        context = (before + after).encode("utf-8", "replace") + b"\n"
        return 8 * (len(self.zstd.compress(context + candidate.encode() + b"\n")) - len(self.zstd.compress(context)))

    def is_random(self, before: str, candidate: str, after: str) -> bool:
        letters = set(candidate)
        if len(letters) <= 4:
            return False
        alphabet = next(a for a in ALPHABETS if letters <= a)
        n, entropy = len(candidate), ENTROPY * math.log2(len(alphabet))
        least = BITS * min(n, SHORT) + entropy * max(0, n - SHORT)
        if len(alphabet) <= 16:  # digits: the compressor codes them all by their entropy, and no identifier looks like that
            least = min(least, entropy * n)
        return self.bits(before, candidate, after) >= least


def sensitive_places(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sensitive words, the end moved past the name that a word stands in; a word is bounded by anything but a letter, or by a change of case."""
    low = text.lower()
    # a letter that gets longer in lower case would shift the places
    for s in SENSITIVE.finditer(low) if len(low) == len(text) else SENSITIVE_ANY_CASE.finditer(text):
        a, b = s.span()
        before, after = text[a - 1 : a], text[b : b + 1]
        opens = not before.isalpha() or text[a].isupper() and (before.islower() or text[a + 1].islower())
        closes = not after.isalpha() or after.isupper() and text[b - 1].islower()
        if opens and closes:
            rest = REST.match(text, b)
            yield a, rest.end() if rest else b


def novel_spans(text: str, novelty: Novelty) -> list[tuple[int, int, int]]:
    """Random strings that begin shortly after a sensitive word, or end shortly before one.  Each string is looked at once, in order, whole."""
    out, done = [], 0  # all before ``done`` has been looked at

    def look(start: int, end: int):
        if novelty.is_random(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]):
            out.append((start, 3, end))

    for a, b in sensitive_places(text):
        if a > done:
            for m in CANDIDATE.finditer(text, max(done, a - NEAR - LONGEST), a):
                inside = m.end() == a and CANDIDATE_CHAR.match(text, a)  # a part of the name that the word stands in
                if a - NEAR <= m.end() and not inside:
                    start = m.start()
                    while start > done and CANDIDATE_CHAR.match(text, start - 1):
                        start -= 1
                    look(start, m.end())
                    done = m.end()
        for m in CANDIDATE.finditer(text, max(b, done), min(len(text), max(b, done) + NEAR + LONGEST)):
            if m.start() > b + NEAR:
                break
            end = m.end()
            if CANDIDATE_CHAR.match(text, end):  # cut by the search's end: the whole string
                end = CANDIDATE.match(text, m.start()).end()
            look(m.start(), end)
            done = end
    return out


def learn_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The identifiers' words that stand around sensitive words in TEXTS texts or more, the commonest last; counted over all texts.

    The LEARNT words that fill most of those places are taken: a bound on the dictionary's size.
    """

    def words(batches):
        for b in slices(batches):
            n: Counter = Counter()
            for t in b.column("text").to_pylist():
                held, done = set(), 0
                for a, e in sensitive_places(t or ""):
                    if e > done:
                        # a string with digits in it may be a key, and a key that is copied is no identifier
                        held.update(WORD.findall(CANDIDATE.sub(lambda m: "" if HAS_DIGIT.search(m[0]) else m[0], t[max(done, a - AROUND) : e + AROUND])))
                        done = e + AROUND
                n.update(held)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TEXTS)
    best = found.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(LEARNT).collect()
    return "".join(f"{r.word} " for r in reversed(best)).encode()


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all spans,
    kind:start:end by start and then kind, comma-joined; code points, end exclusive), n_novel.

    dictionary: words that the compressor knows beforehand; None: learnt from all the texts.
    Null or empty text: no spans.  Repeated rows come out as often as they went
    in; ids may be null.  An empty table gives no rows.
    """
    dictionary = learn_dictionary(docs, text_col) if dictionary is None else dictionary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        novelty = Novelty(dictionary)
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                t = t or ""
                base = base_spans(t)
                extra = novel_spans(t, novelty)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + extra), len(extra)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
