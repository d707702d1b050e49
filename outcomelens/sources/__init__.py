from .files import read_csv, read_json, read_parquet, write_csv, write_json, write_parquet
from .messages import publish, read_message_stream, to_messages

__all__ = [
    "read_csv", "read_json", "read_parquet", "write_csv", "write_json", "write_parquet",
    "publish", "read_message_stream", "to_messages",
]
