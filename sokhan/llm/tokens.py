"""Text sizes in tokens of a public byte-level tokenizer, with the labels that the mixing operator needs, in one pass over the text."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level tokenizers cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stems that tell the topic of a Persian word; the topic of a text is the one most of its words tell.
TOPICS = {
    "delivery": ("ارسال", "پیک", "بسته", "تحویل", "انبار", "رسید"),
    "payment": ("پرداخت", "کارت", "پول", "تومن", "تخفیف", "هزینه", "اقساط", "وجه"),
    "returns": ("مرجوع", "عوض", "خراب", "شکسته", "گارانتی", "جایگزین"),
    "support": ("کارشناس", "پیگیری", "تماس", "پشتیبانی", "تیکت", "سفارش"),
    "law": ("ماده", "تبصره", "مسئولیت", "حقوق", "قرارداد", "آیین", "متعهد", "مقررات"),
}
_WORDS_KEPT = 400_000


def token_counter(path: str = TOKENIZER) -> Callable[[str], tuple[int, str]]:
    """A function text -> (number of tokens, topic).

    No token of these tokenizers spans a single space between words, so the counts of words are kept and added up; a text with other white
    space is encoded whole. "" has no tokens.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    stems = {s: t for t, ss in TOPICS.items() for s in ss}
    sizes: dict[str, int] = {}
    topics: dict[str, str] = {}
    odd: set[str] = set()

    def learn(words: set[str]) -> None:
        if len(sizes) > _WORDS_KEPT:
            sizes.clear()
            topics.clear()
            odd.clear()
        for w in [w for w in words if w not in sizes]:
            sizes[w] = len(encode(" " + w))
            if not w or w[0].isspace() or w[-1].isspace():
                odd.add(w)
            if t := next((t for s, t in stems.items() if w.startswith(s)), ""):
                topics[w] = t

    def count(text: str) -> tuple[int, str]:
        words = text.split(" ")
        distinct = set(words)
        learn(distinct)
        told = [t for t in map(topics.get, words) if t]
        topic = max(sorted(set(told)), key=told.count) if told else "other"
        if not odd.isdisjoint(distinct):
            return len(encode(text)), topic
        return sum(map(sizes.__getitem__, words)) - sizes[words[0]] + len(encode(words[0])), topic

    return count


def _language(text: str, label: str | None) -> str:
    known = {"fa": "fa", "fas": "fa", "per": "fa", "en": "en", "eng": "en", "ar": "ar", "ara": "ar"}
    if label and (k := known.get(label.strip().lower())):
        return k
    head = re.findall(r"[A-Za-z]|[؀-ۿ]|[يةكىإأ]", text)
    latin = sum(c.isascii() for c in head)
    if latin * 2 > len(head):
        return "en"
    return "ar" if sum(c in "يةكىإأ" for c in head) * 12 > len(head) > 0 else "fa"


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of ``documents`` (doc_id, text, source, lang): source names lower case with underscores, languages fa, en or ar.

    Documents with a null id or text, or without a token, are left out; they have no size. Texts are read whole. The tokenizer's file is sent to the executors that don't have it.
    """
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        for b in batches:
            both = [count(t) for t in b.text]
            yield pd.DataFrame(
                {
                    "doc_id": b.doc_id, "source": b.source.str.strip().str.lower().str.replace("-", "_"),
                    "lang": [_language(t, s) for t, s in zip(b.text, b.lang)], "topic": [t for _, t in both], "n_tokens": [n for n, _ in both],
                }
            )

    read = documents.select("doc_id", "text", "source", "lang").filter("doc_id is not null and text is not null and text != ''")
    return read.mapInPandas(run, "doc_id long, source string, lang string, topic string, n_tokens int").filter("n_tokens > 0")
