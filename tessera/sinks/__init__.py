"""Writers and provenance digests."""
