"""From syntax trees to DataFrame plans."""
