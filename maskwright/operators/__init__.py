"""Detection, overlap resolution, pseudonymisation and verification as column operators."""
