"""Structured Streaming: manifests arriving, files growing, databases going quiet, tables growing."""

from tableproof.streaming.arrival import stream_arrival
from tableproof.streaming.catalogue import stream_manifests
from tableproof.streaming.fingerprints import stream_fingerprint
from tableproof.streaming.ledger import fingerprints_at, stream_changes
from tableproof.streaming.silence import stream_silence
from tableproof.streaming.staleness import stream_staleness
from tableproof.streaming.watch import watch_arrival

__all__ = ["fingerprints_at", "stream_arrival", "stream_changes", "stream_fingerprint", "stream_manifests", "stream_silence", "stream_staleness", "watch_arrival"]
