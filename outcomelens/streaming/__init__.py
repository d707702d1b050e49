from .scoring import commit_log, committed, decode, parse, read_committed, score, score_stream, split_valid, write_batch
from .stopping import OrderlyStop, file_mark

__all__ = ["OrderlyStop", "commit_log", "committed", "decode", "file_mark", "parse", "read_committed", "score", "score_stream", "split_valid", "write_batch"]
