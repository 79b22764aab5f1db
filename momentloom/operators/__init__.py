"""DataFrame operators over corpora of timelines."""
