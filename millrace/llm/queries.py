"""All queries of the subpackage: importing the operators registers theirs."""

from millrace.llm import chat, collocations, decontaminate, licenses, packing, quality, repeats, simhash, structure, token_files, toxicity, warc, wrapper  # noqa: F401
from millrace.llm.common import ORACLE, QUERIES  # noqa: F401
