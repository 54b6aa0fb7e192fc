"""Text, co-occurrence and frame analytics as DataFrame functions."""
