"""The flow operators over streams of packets: file ingest, windows, sessions."""
