"""Analytics over semi-structured records, as DataFrame plans."""
