"""The corpus pipeline: stages over the documents table, each written and read by the next."""

from __future__ import annotations

from tidemark.llm import jaccard, mixing, packing, quality, secrets
from tidemark.llm.common import documents, materialize
from tidemark.llm.tokens import default_vocabulary


def keep_good(spark, docs, sf_dir):
    """Rejected documents go, and lines that too many documents of a host share.

    Null and empty texts are rejected; repeated rows are judged each; null hosts are a host; a very long text is judged
    whole; other columns stay as they are; an empty table gives an empty one. The same holds of columns in all stages.
    """
    return quality.keep_good(docs)


def one_of_each_group(spark, docs, sf_dir):
    """Of documents linked by word shingles the one with the least id stays.

    Null and empty texts link with nothing and stay. Of repeated rows one stays; null ids come after all others, and among
    equal ids the least hash of id and text decides; an empty table gives an empty one.
    """
    return jaccard.one_of_each(docs)


def mask_secrets(spark, docs, sf_dir):
    """Secrets are masked in the text, also those inside encoded parts.

    All rows stay, in any number of repeats; null texts stay null; an empty table gives an empty one.
    """
    return secrets.mask_secrets(docs)


def sample_mix(spark, docs, sf_dir):
    """Documents are sampled towards the target weights of source, language and topic.

    Null attributes count as empty ones, a value of their own; repeated rows share one draw, as do rows without id but with one text;
    an empty table gives an empty one.
    """
    return mixing.sample(docs)


def pack(spark, docs, sf_dir):
    """Pieces of token sequences filled by lexical neighbours, in place of the documents' columns.

    A null or empty text is the end id alone; repeated rows and null ids are packed each; a long text goes over several
    sequences; an empty table gives no row.
    """
    return packing.pack_documents(docs, default_vocabulary())


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each_group), ("secrets", mask_secrets), ("mixing", sample_mix), ("packing", pack)]
#: Near-duplicate components, recursive decoding and retrieval packing have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
