"""Chart packs and research packets, assembled from operators."""
